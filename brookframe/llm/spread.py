"""Joins whose left side may have a third of all its rows under one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heavy_keys(counts: DataFrame, keys: Sequence[str], total: int, count: str = "n", most: int = 1000, least: int = 256) -> list[tuple]:
    """The keys with more than total/most rows (and more than `least`), so at most `most` of them. counts: a row per key."""
    return [tuple(r) for r in counts.where(F.col(count) > max(least, total // most)).select(*keys).collect()]


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], heavy: list[tuple], by: Sequence[str], how: str = "inner", pieces: int = 64) -> DataFrame:
    """left.join(right, keys, how) with the rows of heavy keys dealt to `pieces` tasks by a hash of the columns `by`.

    right has few rows for each key (one, usually): those of heavy keys are repeated for each piece.
    """
    if not heavy:
        return left.join(right, [*keys], how)
    hot = left.sparkSession.createDataFrame(heavy, left.select(*keys).schema).withColumn("_hot", F.lit(True))  # 1000 rows at most
    zero = F.lit(0).cast("long")
    mine = left.join(F.broadcast(hot), [*keys], "left").withColumn("_piece", F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(pieces))).otherwise(zero)).drop("_hot")
    theirs = right.join(F.broadcast(hot), [*keys], "left")
    theirs = theirs.withColumn("_piece", F.explode(F.when(F.col("_hot"), F.sequence(zero, zero + pieces - 1)).otherwise(F.array(zero)))).drop("_hot")
    return mine.join(theirs, [*keys, "_piece"], how).drop("_piece")
