"""Shared parts of the two vector searches: valid rows, bounded blocks of queries, merging of each task's best."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid_vectors(df: DataFrame, id_col: str, vector_col: str, nonzero: bool = False) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: id and vector not null, all components finite, the commonest length."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0").where(fine.isNotNull() & fine)
    if nonzero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common.n if common else 0))


def query_blocks(rows: DataFrame, every: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the rows with vec_id divisible by `every`, in blocks of about `most` rows on the driver, one at a time."""
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct()
    blocks = -(-queries.count() // most)
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()
        if own:
            yield np.array([r.vec_id for r in own], np.int64), np.array([r.v for r in own], float)


def in_groups(batches: Iterator[pa.RecordBatch], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The rows of a task in batches of about `rows`, whatever the session's Arrow batches are; empty ones are left out."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def best_of(found: DataFrame, k: int, descending: bool) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of all tasks, ties to the smaller vec_id."""
    score = F.col("score").desc() if descending else F.col("score").asc()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(score, "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def union_all(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for df in parts:
        out = df if out is None else out.union(df)
    return out
