"""Bounded samples of labelled rows for fitting, and folds by the checksum of an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's text leaves `fold` modulo `folds`; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % folds == fold, F.lit(False))


def bounded_sample(known: DataFrame, rows: int) -> list[tuple]:
    """(key, value) of known, the same number of each value as far as it has them: `rows` in all, and one of each value at least.

    known: (key, value, fits), a row for each key; only keys that fit are chosen: those with the least hashes. Counts by the size
    of the hash tell how far these reach, so that of a value with very many keys only about twice the wanted are ordered.
    """
    key, value = known.columns[:2]
    fitting = known.where(F.col(key).isNotNull() & F.col(value).isNotNull() & F.col("fits")).select(key, value)
    number = F.xxhash64(F.lit("fit"), key).bitwiseAND((1 << 62) - 1)
    drawn = fitting.withColumn("_u", number).withColumn("_size", F.floor(F.log2(F.col("_u") + 1)).cast("int"))
    # how many keys of a value have numbers below each power of two: 63 rows for each value at most
    counts = drawn.groupBy(value, "_size").agg(F.count(F.lit(1)).alias("_n"))
    values = counts.select(value).distinct().count()
    if not values:
        return []
    most = max(1, rows // values)
    before = F.sum("_n").over(Window.partitionBy(value).orderBy("_size")) - F.col("_n")
    reach = counts.withColumn("_before", before).where(F.col("_before") < most).groupBy(value).agg(F.max("_size").alias("_reach"))
    # twice as many rows as are wanted, or so, are ordered
    near = drawn.join(F.broadcast(reach), value).where("_size <= _reach")  # a row for each value
    nth = F.row_number().over(Window.partitionBy(value).orderBy("_u", key))
    return [tuple(r) for r in near.withColumn("_nth", nth).where(F.col("_nth") <= most).select(key, value).collect()]


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, chars: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, str, int]]:
    """(id, text, label) of `rows` labelled documents (or fewer) outside the held-out fold, in order of id: as many of either label.

    Only texts of at most `chars` characters are used for fitting, so that the sample's size is bounded. An id with several
    labels has the smallest; of an id with several texts all that fit are used.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    known = labels.where(~in_fold("doc_id", folds, held_out) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min(label).alias("_label"))
    sizes = own.where("_id is not null and _text is not null").groupBy("_id").agg((F.min(F.length("_text")) <= chars).alias("fits"))
    chosen = dict(bounded_sample(known.join(sizes, "_id"), rows))
    if not chosen:
        return []
    ids = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in chosen], "_id long"))  # `rows` ids at most
    found = own.where(F.length("_text") <= chars).join(ids, "_id")
    return sorted({(r._id, r._text, int(chosen[r._id])) for r in found.collect()})
