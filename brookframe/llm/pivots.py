"""Exact top-k inner products by pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sample import least_hashed
from .scratch import Scratch
from .vectors import best_of, in_groups, matrix, query_blocks, union_all, valid_vectors


@dataclass(frozen=True)
class Pivots:
    """pivots are chosen, far from each other, among `sample` vectors; queries go to the tasks in blocks of about `block`."""

    pivots: int = 32
    sample: int = 2048
    block: int = 2048
    chunk: int = 128
    scale: int = 1024


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """The origin (its distances are the norms), then each time the vector farthest from all before."""
    chosen = [np.zeros(sample.shape[1])]
    far = np.sqrt((sample**2).sum(axis=1))
    while len(chosen) < n and far.size and far.max() > 0:
        chosen.append(sample[int(far.argmax())])
        far = np.minimum(far, np.sqrt(((sample - chosen[-1]) ** 2).sum(axis=1)))
    return np.array(chosen)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _measure(pivots: np.ndarray):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = distances(matrix(batch.column("v")), pivots)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, table.size + 1, table.shape[1], dtype=np.int32)), pa.array(table.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists], ["vec_id", "v", "table"])

    return measure


def _search(ids: np.ndarray, queries: np.ndarray, table: np.ndarray, k: int, chunk: int):
    norms = (queries**2).sum(axis=1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]  # each query's best so far: scores, vec_ids
        for batch in in_groups(batches):
            x, own, of = matrix(batch.column("v")), batch.column("vec_id").to_numpy(), matrix(batch.column("table"))
            half = (x**2).sum(axis=1) / 2
            for i in range(len(ids)):
                # triangle inequality: no candidate is nearer than the greatest difference of distances to a pivot
                least = np.abs(of - table[i]).max(axis=1)
                most = half + norms[i] / 2 - least**2 / 2
                most += 1e-6 + 1e-9 * np.abs(most)  # rounding
                most[own == ids[i]] = -np.inf
                scores, who = kept[i]
                bar = scores[-1] if len(scores) == k else -np.inf
                order = np.flatnonzero((most >= bar) & (most > -np.inf))
                order = order[np.argsort(-most[order], kind="stable")]
                for at in range(0, len(order), chunk):
                    part = order[at : at + chunk]
                    if len(scores) == k and most[part[0]] < scores[-1]:
                        break
                    scores, who = np.r_[scores, x[part] @ queries[i]], np.r_[who, own[part]]
                    best = np.lexsort((who, -scores))[:k]
                    scores, who = scores[best], who[best]
                kept[i] = scores, who
        n = [len(s) for s, _ in kept]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate([w for _, w in kept])), pa.array(np.concatenate([s for s, _ in kept]).astype(np.int64))], ["query_id", "vec_id", "score"])

    return search


def top_inner_products(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, p: Pivots = Pivots()) -> DataFrame:
    """Each query's k highest integer inner products: query_id, rank, vec_id, score.

    Components become floor(p.scale * x). Queries are the rows whose id is divisible by `every`, candidates all rows
    but those of the query's own id; ties go to the smaller vec_id. The candidates' distances to all pivots are
    written once. For a query they give each candidate a lower bound of its distance, hence an upper bound of its
    product; candidates are evaluated from the highest bound down until the k-th best product is above the next.

    Vectors that are null, hold null, NaN or infinite components, have a null id, or are not of the commonest length,
    take no part. Repeated rows are candidates each; a query id with several vectors asks for the best of all of
    them. Fewer than k candidates: all are returned. An empty table gives an empty result. Products are exact below 2**53.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "pivots")
    rows = valid_vectors(df, id_col, vector_col).select("vec_id", F.transform("v", lambda x: F.floor(x * p.scale).cast("double")).alias("v"))
    rows = scratch.write(rows, "vectors")
    sample = least_hashed(rows, ["vec_id"], "v", p.sample)
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = choose_pivots(np.array(sample, float), p.pivots)
    measured = scratch.write(rows.mapInArrow(_measure(pivots), "vec_id long, v array<double>, table array<double>"), "table")
    parts = []
    for ids, queries in query_blocks(rows, every, p.block):
        step = _search(ids, queries, distances(queries, pivots), k, p.chunk)
        parts.append(scratch.write(measured.mapInArrow(step, "query_id long, vec_id long, score long"), "found"))
    found = union_all(parts)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best_of(found, k, True)
