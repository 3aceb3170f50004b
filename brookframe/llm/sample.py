"""Samples of rows for fitting, chosen by hash, of which no task or driver gets more than about twice the wanted number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def least_hashed(df: DataFrame, by: Sequence[str], column: str, rows: int) -> list:
    """`column` of the `rows` rows with the least hashes of the columns `by`, in order of hash; all, if df has fewer.

    Counts by the size of the hash tell first how far these reach (63 rows at most), so that only about twice as many are
    collected, however many tasks read df. Rows with equal `by` count once. An empty table gives an empty list.
    """
    number = F.xxhash64(*[F.col(f"`{c}`") for c in by]).bitwiseAND((1 << 62) - 1)
    drawn = df.select(number.alias("u"), F.col(f"`{column}`").alias("v")).withColumn("size", F.floor(F.log2(F.col("u") + 1)).cast("int"))
    counts = drawn.groupBy("size").agg(F.approx_count_distinct("u", 0.02).alias("n")).collect()
    reach, seen = -1, 0
    for size, n in sorted(map(tuple, counts)):
        if seen < 1.1 * rows:  # the counts of distinct hashes are right to a few parts in a hundred
            reach, seen = size, seen + n
    near: list[Row] = drawn.where(F.col("size") <= reach).groupBy("u").agg(F.first("v").alias("v")).collect()
    return [r.v for r in sorted(near, key=lambda r: r.u)[:rows]]
