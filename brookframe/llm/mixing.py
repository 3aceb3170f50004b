"""Temperature mixing of sources, realised as budgeted block permutations."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, lean
from .spread import heavy_keys, spread_join
from .words import SPACE, text_slices


@dataclass(frozen=True)
class Mixing:
    """Either repeat_limit, the most epochs of any source while each gets one at least, or entropy, in nats.

    block_words: about the words of a block. A source has 1 to max_blocks blocks, as one task orders the blocks of a source, so
    blocks of a source beyond block_words * max_blocks words are larger. listed: so many sources go to each task; the
    settings of more are joined.
    """

    repeat_limit: float | None = 1.5
    entropy: float | None = None
    seed: int = 11
    block_words: int = 100_000
    max_blocks: int = 65_536
    listed: int = 100_000


def _weights(share: np.ndarray, power: float) -> np.ndarray:
    w = share**power
    return w / w.sum()


def _bisect(flat_enough: Callable[[list[float]], list[bool]], grid: int) -> tuple[float, float]:
    """Ends of a tiny interval of [0, 1]: flat_enough holds at the lower one (or nowhere: 0, 0) and not at the upper one.

    grid: exponents that are asked for at once, 1 for plain bisection.
    """
    if not flat_enough([0.0])[0]:
        return 0.0, 0.0
    low, high = 0.0, 1.0
    while high - low > 1e-12:
        asked = [low + (high - low) * i / (grid + 1) for i in range(1, grid + 1)]
        holds = [a for a, x in zip(asked, flat_enough(asked), strict=True) if x]
        low, high = (max(holds), min([a for a in asked if a > max(holds)] or [high])) if holds else (low, asked[0])
    return low, high


def temperature(least: float, most: float, m: Mixing, entropies: Callable[[list[float]], list[float]], grid: int = 1) -> float:
    """The power in [0, 1] of the shares of words, the flattest that meets the target, by bisection.

    least, most: words of the smallest and the largest source; entropies: of the weights at given powers. A lower power is
    flatter: it has more entropy and repeats small sources more. If power 1 misses the entropy asked for from above, or
    power 0 from below, that end is taken.
    """
    if m.entropy is not None:
        return _bisect(lambda powers: [x >= m.entropy for x in entropies(powers)], grid)[0]
    # epochs are words to the power less one, so the smallest source has the most
    return _bisect(lambda powers: [(least / most) ** (p - 1) > m.repeat_limit for p in powers], 1)[1]


def temperature_weights(words: list[int], m: Mixing = Mixing()) -> tuple[float, list[float]]:
    """(exponent, weights) of a list of sources' words."""
    share = np.array(words, float) / sum(words)

    def entropies(powers: list[float]) -> list[float]:
        return [float(-(w * np.log(w)).sum()) for w in (_weights(share, p) for p in powers)]

    power = temperature(min(words), max(words), m, entropies)
    return power, _weights(share, power).tolist()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [np.zeros(0, np.int64)]
        for _, buf, offs in text_slices(batch.column("text")):
            begins = ~SPACE[buf]
            begins[1:] &= SPACE[buf[:-1]]
            edge = offs[:-1][offs[:-1] < len(buf)]
            begins[edge] = ~SPACE[buf[edge]]
            total = np.r_[0, np.cumsum(begins)]
            counts.append(total[offs[1:]] - total[offs[:-1]])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(np.concatenate(counts), pa.int64())], ["doc_id", "source", "words"])


def mixture(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", m: Mixing = Mixing()) -> DataFrame:
    """One row per document and epoch in the mixture: doc_id, source, words, epoch, block, block_order, doc_order.

    A source's weight is its share of all words to a power found by bisection; the budget is the least that gives every
    source one whole epoch, so no document is lost and sources below their weight are repeated. Each epoch of a source
    is a permutation of its blocks and of the documents in them, by keyed hashes (sort by epoch, block_order,
    doc_order). A last, partial epoch takes blocks in order while the budget lasts, and of the block where it ends,
    documents in order while their words fit.

    Nulls: a null source is a source of its own; rows with a null doc_id occur once each, in epoch 0. A null or empty
    text has no words; a source without words occurs once. Rows of one doc_id and source are one document, with their
    words added. A text of any length is read whole. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counted = scratch.write(plain.mapInArrow(lean(_count_words), "doc_id long, source string, words long"), "words")
    known = counted.where("doc_id is not null")
    totals = scratch.write(known.groupBy("source").agg(F.sum("words").alias("total"), F.count(F.lit(1)).alias("n")), "totals")
    live = totals.where("total > 0")
    sums = live.agg(F.sum("total").alias("all"), F.min("total").alias("least"), F.max("total").alias("most"), F.count(F.lit(1)).alias("sources")).first()
    power, budget, scale = 1.0, 0.0, 1.0
    if sums.sources:
        share = F.col("total") / F.lit(float(sums["all"]))

        def entropies(powers: list[float]) -> list[float]:
            """-sum(w ln w) of the weights at each power, in one pass over the sources."""
            parts = [x for i, p in enumerate(powers) for x in (F.sum(F.pow(share, F.lit(p))).alias(f"z{i}"), F.sum(F.pow(share, F.lit(p)) * F.log(share)).alias(f"l{i}"))]
            row = live.agg(*parts).first()
            return [math.log(row[f"z{i}"]) - p * row[f"l{i}"] / row[f"z{i}"] for i, p in enumerate(powers)]

        power = temperature(sums.least, sums.most, m, entropies, 63)
        scale = live.agg(F.sum(F.pow(share, F.lit(power)))).first()[0]
        # the least budget that gives every source one epoch: words / weight is greatest for the largest source
        budget = sums["all"] * scale * (sums.most / sums["all"]) ** (1 - power)
    epochs = F.greatest(F.lit(1.0), F.pow(F.col("total") / F.lit(float(sums["all"] or 1)), F.lit(power - 1)) * F.lit(budget / scale / (sums["all"] or 1)))
    whole = F.when(F.col("total") > 0, F.floor(epochs + 1e-9)).otherwise(1).cast("int")
    rest = F.when(F.col("total") > 0, F.floor(F.greatest(F.lit(0.0), epochs - whole) * F.col("total"))).otherwise(0).cast("long")
    blocks = F.least(F.lit(m.max_blocks), F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(m.block_words)))).cast("long")
    settings = scratch.write(totals.select("source", "n", whole.alias("whole"), rest.alias("rest"), blocks.alias("blocks")), "settings")

    seed = F.lit(m.seed)
    units = known.groupBy("doc_id", "source").agg(F.sum("words").alias("words"))
    if settings.count() <= m.listed:
        units = units.join(F.broadcast(settings.withColumnRenamed("source", "s").drop("n")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    else:
        named = lambda df: df.withColumn("_s", F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit(""))))
        one = named(settings)
        units = spread_join(named(units), one.drop("source", "n"), ["_s"], heavy_keys(one, ["_s"], one.agg(F.sum("n")).first()[0]), ["doc_id"]).drop("_s")
    units = scratch.write(units.withColumn("block", F.pmod(F.xxhash64(seed, F.lit("block"), "doc_id"), "blocks")), "units")
    block_order, doc_order = F.xxhash64(seed, "epoch", F.coalesce("source", F.lit("")), "block"), F.xxhash64(seed, "epoch", "doc_id")

    def ordered(df: DataFrame) -> DataFrame:
        return df.withColumn("block_order", block_order).withColumn("doc_order", doc_order)

    whole = ordered(units.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1))))
    # the last epoch: blocks wholly within the rest, then documents of the block in which it ends
    last = units.where("rest > 0").withColumn("epoch", F.col("whole"))
    sums = last.groupBy("source", "block", "epoch", "rest").agg(F.sum("words").alias("block_words")).withColumn("block_order", block_order)
    upto = F.sum("block_words").over(Window.partitionBy("source").orderBy("block_order", "block"))
    cut = sums.withColumn("left", F.col("rest") - upto + F.col("block_words")).where("left > 0")
    chosen = ordered(last).join(cut.select(F.col("source").alias("s"), F.col("block").alias("b"), "block_words", "left"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    entire = chosen.where("block_words <= left")
    ending = chosen.where("block_words > left").withColumn("_upto", F.sum("words").over(Window.partitionBy("source").orderBy("doc_order", "doc_id"))).where("_upto <= left")
    out = ["doc_id", "source", "words", F.col("epoch").cast("int").alias("epoch"), "block", "block_order", "doc_order"]
    nameless = counted.where("doc_id is null").select("doc_id", "source", "words", F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("block_order"), F.lit(0).cast("long").alias("doc_order"))
    return whole.select(*out).union(entire.select(*out)).union(ending.select(*out)).union(nameless)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", m: Mixing = Mixing()) -> DataFrame:
    """docs with each row as often as its document occurs in the mixture; same columns.

    Rows with a null doc_id occur once; a null source is a source of its own; null and empty texts occur as often as others of
    their source. Repeated rows are repeated alike. Texts of any length stay whole. An empty table gives an empty result.
    Columns pass through, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    found = mixture(docs, id_col, source_col, text_col, m).where("doc_id is not null").groupBy("doc_id", F.xxhash64("source").alias("s")).agg(F.count(F.lit(1)).cast("int").alias("times"))
    found = scratch.write(found.withColumnRenamed("doc_id", "d"), "times")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    source = F.xxhash64(F.col(f"`{source_col}`").cast("string"))
    keyed = docs.where(F.col(f"`{id_col}`").isNotNull()).select(row, F.col(f"`{id_col}`").cast("long").alias("d"), source.alias("s"))
    repeated = keyed.join(found, ["d", "s"]).select("row", F.explode(F.sequence(F.lit(1), "times")).alias("nth"))
    return repeated.select("row.*").union(docs.where(F.col(f"`{id_col}`").isNull()))
