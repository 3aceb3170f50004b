"""Shards along a Hilbert curve through quantised metadata, so that each file covers a small box of every dimension."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch


@dataclass(frozen=True)
class Curve:
    """bits: each dimension is cut at up to 2**bits - 1 quantiles of all rows; those of strings are exact, others approximate."""

    bits: int = 7
    accuracy: int = 10_000


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The Hilbert index of each row of cells (n rows, one column per dimension, values below 2**bits)."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    n = len(x)
    # walk from the coarsest bit: undo the reflections and exchanges that the curve makes inside each half
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            high = (x[i] >> b & 1).astype(bool)
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | ((v ^ flip) >> b & 1)
    return out


def _code(df: DataFrame, dim: str) -> Column:
    """A number that follows the order of a column that is not a string; null and NaN come first."""
    c = F.col(f"`{dim}`")
    kind = df.schema[dim].dataType
    if isinstance(kind, T.NumericType | T.BooleanType):
        number = F.when(~F.isnan(c.cast("double")), c.cast("double"))
    elif isinstance(kind, T.DateType | T.TimestampType):
        number = F.unix_micros(c.cast("timestamp")).cast("double")
    else:
        number = F.xxhash64(c).cast("double")
    return F.coalesce(number, F.lit(-1e300))


def _string_edges(df: DataFrame, dim: str, curve: Curve, scratch: Scratch) -> np.ndarray:
    """Whole strings that cut the sorted values of all rows in 2**bits - 1 about equal parts: the rows n * i // parts, for each i.

    Rows of each value are counted, values are range-sorted, and counts are summed within the ranges, of which one number each goes
    to the driver; only the edges are collected.
    """
    parts, ranges = (1 << curve.bits) - 1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(f"`{dim}`").isNotNull()).groupBy(F.col(f"`{dim}`").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    values = scratch.write(counts.repartitionByRange(ranges, "value").withColumn("part", F.spark_partition_id()), "values")
    starts, total = [], 0
    for part, n in sorted(values.groupBy("part").agg(F.sum("n")).collect()):  # a row per range
        starts.append((part, total))
        total += n
    if not total:
        return np.array([], object)
    start = F.broadcast(df.sparkSession.createDataFrame(starts, "part int, start long"))
    upto = values.join(start, "part").withColumn("upto", F.col("start") + F.sum("n").over(Window.partitionBy("part").orderBy("value")))
    # the first edge not before the value's first row, and whether it is before the next value's
    least = F.expr(f"((upto - n) * {parts} + {total - 1}) div {total}")
    edges = upto.withColumn("i", least).where(f"i < {parts} and ({total} * i) div {parts} < upto")
    return np.array([r.value for r in edges.select("value").orderBy("value").collect()], object)


def hilbert_order(df: DataFrame, dims: Sequence[str], curve: Curve = Curve(), scratch: Scratch | None = None) -> DataFrame:
    """df with curve_index added: the place of the row's quantised dims on the curve. scratch: where counts of strings are written."""
    scratch = scratch or Scratch(df.sparkSession, "hilbert")
    texts = [d for d in dims if isinstance(df.schema[d].dataType, T.StringType)]
    numbers = [d for d in dims if d not in texts]
    shares = [i / (1 << curve.bits) for i in range(1, 1 << curve.bits)]
    row = df.select(*[_code(df, d).alias(str(i)) for i, d in enumerate(numbers)]).agg(*[F.percentile_approx(str(i), shares, curve.accuracy).alias(str(i)) for i in range(len(numbers))]).first() if numbers else ()
    edges = {d: np.unique(np.array(e or [], float)) for d, e in zip(numbers, row, strict=True)} | {d: _string_edges(df, d, curve, scratch) for d in texts}

    def cells(dim: str, column: pd.Series) -> np.ndarray:
        if dim in numbers:
            return np.searchsorted(edges[dim], column.to_numpy(float), "left")
        codes, values = pd.factorize(column)  # a null has code -1, and cell 0
        return np.r_[np.searchsorted(edges[dim], np.array(values, object), "right") if len(edges[dim]) else np.zeros(len(values), np.int64), 0][codes]

    @F.pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        places = np.stack([cells(d, c) for d, c in zip(dims, columns, strict=True)], axis=1)
        return pd.Series(curve_index(np.minimum(places, (1 << curve.bits) - 1), curve.bits))

    return df.withColumn("curve_index", index(*[F.col(f"`{d}`") if d in texts else _code(df, d) for d in dims]))


def hilbert_shards(docs: DataFrame, shards: int = 40, dims: Sequence[str] = ("lang", "source", "size"), id_col: str = "doc_id", text_col: str = "text", curve: Curve = Curve()) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve_index and the dims.

    Rows are ordered by curve index, then text checksum (so that copies in one cell stand side by side) and doc_id, and
    cut in runs: law `rows`, the shards' counts are at most one apart. slot counts from 0 in each shard. size is the
    text's UTF-8 bytes plus 16, and may be one of dims; grown_shard is null, as a cut by rank moves rows when a shard
    is added.

    Nulls: a null text has size 16 and checksum 0; null dims come first on their axis; a null doc_id sorts first.
    Repeated rows take slots of their own. With fewer rows than shards, the last shards are empty. An empty table
    gives an empty result. Other columns, whatever their names, are not read. A text of any length counts with its whole size.
    Equal texts are adjacent only within one cell of the curve, and a group of them may be cut by the end of a shard.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "hilbert")
    text = F.col(f"`{text_col}`").cast("string")
    own = [d for d in dims if d != "size"]
    base = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"),
        *[F.col(f"`{d}`") for d in own],
    )
    rows = scratch.write(base, "rows").withColumn("tie", F.monotonically_increasing_id())
    order = ["curve_index", "text_crc32", "doc_id", "tie"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = hilbert_order(rows, dims, curve, scratch).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tie")
    # partition number in the upper bits, place in the partition in the lower 33
    placed = scratch.write(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    counts = dict(placed.groupBy(F.shiftright("at", 33).alias("part")).count().collect())  # a row per partition
    total = sum(counts.values())
    starts, seen = [], 0
    for part in sorted(counts):
        starts.append((part, seen))
        seen += counts[part]
    start = F.broadcast(spark.createDataFrame(starts, "part long, start long"))
    ranked = placed.withColumn("part", F.shiftright("at", 33)).join(start, "part").withColumn("rank", F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1))
    each, longer = divmod(total, shards)
    cut = longer * (each + 1)
    in_long = F.col("rank") < cut
    after = F.floor((F.col("rank") - cut) / F.lit(max(each, 1)))
    shard = F.when(in_long, F.floor(F.col("rank") / F.lit(each + 1))).otherwise(longer + after)
    slot = F.when(in_long, F.col("rank") % (each + 1)).otherwise((F.col("rank") - cut) % max(each, 1))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve_index", *own)


def manifest(sharded: DataFrame, dims: Sequence[str]) -> DataFrame:
    """For each shard its rows and the least and greatest value of each dimension: what a reader needs to skip shards."""
    ends = [f(d).alias(f"{name}_{d}") for d in dims for name, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *ends)


def write_shards(docs: DataFrame, sharded: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write docs in one folder per shard, sorted along the curve; null doc_ids are not written, ids must be unique.

    Null and empty texts, and texts of any length, are written as they are. No documents: nothing is written. Columns `shard` and
    `slot` are added, so docs must not have them; other names do not matter.
    """
    placed = docs.join(sharded.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
