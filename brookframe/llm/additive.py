"""Approximate nearest neighbours by additive quantisation with exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .sample import least_hashed
from .scratch import Scratch
from .vectors import best_of, in_groups, matrix, query_blocks, union_all, valid_vectors


@dataclass(frozen=True)
class Additive:
    """books codebooks of `entries` full-dimensional vectors (a quarter of the sample, if it has fewer than four times as many)
    are fitted on `sample` rows; every row is encoded.

    rerank: candidates of a query that a task scores exactly at first, for each 10,000 entries or so that it reads; then it
    scores all others whose stored error leaves it open whether they are nearer than the k-th of these.
    """

    books: int = 16
    entries: int = 256
    beam: int = 4
    sample: int = 8192
    iterations: int = 6
    rerank: int = 400
    block: int = 2048
    seed: int = 3


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def fit_codebooks(sample: np.ndarray, p: Additive) -> np.ndarray:
    """books x entries x dimension: each book is a k-means of what the books before leave over."""
    rng, left = np.random.default_rng(p.seed), sample.astype(np.float32)
    n = max(1, min(p.entries, len(left) // 4))
    books = []
    for _ in range(p.books):
        centres = left[rng.permutation(len(left))[:n]].copy()
        for _ in range(p.iterations):
            own = _nearest(left, centres)
            count = np.bincount(own, minlength=n)
            some = count > 0
            sums = np.add.reduceat(left[np.argsort(own, kind="stable")], (np.cumsum(count) - count)[some])
            centres[some] = sums / count[some, None]
        books.append(centres)
        left = left - centres[_nearest(left, centres)]
    return np.array(books)


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """Codes (one byte per book) by beam search: after each book the `beam` partial sums nearest to x go on."""
    m, n, d = books.shape
    codes = np.zeros((len(x), 1, 0), np.int64)
    left = x[:, None, :]
    rows = np.arange(len(x))[:, None]
    for b in range(m):
        cost = (left**2).sum(axis=2)[:, :, None] + (books[b] ** 2).sum(axis=1) - 2 * (left.reshape(-1, d) @ books[b].T).reshape(len(x), -1, n)
        wide = cost.reshape(len(x), -1)
        keep = min(beam, wide.shape[1]) if b < m - 1 else 1
        best = np.argpartition(wide, keep - 1, axis=1)[:, :keep]
        codes = np.concatenate([codes[rows, best // n], (best % n)[:, :, None]], axis=2)
        left = left[rows, best // n] - books[b][best % n]
    return codes[:, 0].astype(np.uint8)


def _equal_as_one(x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of equal vectors: the first row of each, where its ids start (and the end of all), and the ids in turn.

    An entry keeps its 2k smallest ids, and k times at most any of them: k stay when one id, a query's own, is left out.
    """
    whole = np.ascontiguousarray(x + 0.0)  # no negative zeros
    _, shown, entry = np.unique(whole.view(np.dtype((np.void, whole.itemsize * whole.shape[1]))).ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((ids, entry))
    entry, ids = entry[order], ids[order]
    for most, new in ((k, (np.diff(entry) != 0) | (np.diff(ids) != 0)), (2 * k, None)):
        first = np.flatnonzero(np.r_[True, np.diff(entry) != 0 if new is None else new])
        keep = np.arange(len(ids)) - np.repeat(first, np.diff(np.r_[first, len(ids)])) < most
        entry, ids = entry[keep], ids[keep]
    return shown, np.searchsorted(entry, np.arange(len(shown) + 1)), ids


def _encoder(books: np.ndarray, beam: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_groups(batches):
            whole = matrix(batch.column("v"))
            shown, first, ids = _equal_as_one(whole, batch.column("vec_id").to_numpy(), k)
            whole = whole[shown]
            x = whole.astype(np.float32)
            codes = np.concatenate([encode(x[i : i + 512], books, beam) for i in range(0, len(x), 512)])
            near = sum(books[b][codes[:, b]] for b in range(len(books)))
            error = np.sqrt(((whole - near) ** 2).sum(axis=1))
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([lists, batch.column("v").take(pa.array(shown)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((near.astype(float) ** 2).sum(axis=1)), pa.array(error)], ["vec_ids", "v", "codes", "norm", "error"])

    return run


def _search(ids: np.ndarray, queries: np.ndarray, books: np.ndarray, k: int, rerank: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, lookup = [], np.einsum("bnd,qd->qbn", books, queries.astype(np.float32))
        for batch in in_groups(batches):
            x, norm, error = matrix(batch.column("v")), batch.column("norm").to_numpy(), batch.column("error").to_numpy()
            own, count = batch.column("vec_ids").flatten().to_numpy(), batch.column("vec_ids").value_lengths().to_numpy()
            first, entry = np.cumsum(count) - count, np.repeat(np.arange(len(count)), count)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)

            def exact(near: np.ndarray, query: np.ndarray, query_id: int) -> tuple[np.ndarray, np.ndarray]:
                """Ids and distances of the rows of some entries, without the query's own id."""
                n = count[near]
                rows = np.repeat(first[near] - np.cumsum(n) + n, n) + np.arange(n.sum())
                far = np.repeat(np.sqrt(((x[near] - query) ** 2).sum(axis=1)), n)
                other = own[rows] != query_id
                return own[rows][other], far[other]

            for i in range(len(ids)):
                square = norm + (queries[i] ** 2).sum()
                slack = 1e-5 * square  # single precision of the tables
                for b in range(codes.shape[1]):
                    square -= 2 * lookup[i, b][codes[:, b]]
                mine = entry[own == ids[i]]
                alone = mine[np.bincount(mine, minlength=len(count))[mine] == count[mine]]
                square[alone] = np.inf
                n = min(rerank, len(square))
                near = np.argpartition(square, n - 1)[:n]
                found, far = exact(near, queries[i], ids[i])
                # a vector is no nearer than its sum less its error: of the others, all that can reach the k-th best so far
                reach = np.partition(far, k - 1)[k - 1] if len(far) >= k else np.inf
                more = square - slack <= (reach + error) ** 2
                more[near] = more[alone] = False
                if more.any():
                    found, far = (np.concatenate(c) for c in zip((found, far), exact(np.flatnonzero(more), queries[i], ids[i]), strict=True))
                best = np.lexsort((found, far))[:k]
                out.append((np.full(len(best), ids[i]), found[best], far[best]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return search


def nearest_neighbours(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, p: Additive = Additive()) -> DataFrame:
    """Each query's k nearest found by Euclidean distance: query_id, rank, vec_id, score (that distance, in doubles).

    Queries are the rows whose id is divisible by `every`, candidates all rows but those of the query's own id. Vectors
    are sums of one entry from each codebook; a task scores its rows by lookup tables and stored norms, measures the
    p.rerank best of each 10,000 exactly, and then every other that by the stored error of its sum may be among the k
    nearest. Equal vectors that a task reads together are one entry. Ties go to the smaller vec_id.

    Vectors that are null or zero, hold null, NaN or infinite components, have a null id, or are not of the commonest
    length, take no part. Repeated rows are candidates each. Fewer than k candidates: all are returned. An empty table
    gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "additive")
    rows = scratch.write(valid_vectors(df, id_col, vector_col, nonzero=True), "vectors")
    sample = least_hashed(rows, ["vec_id"], "v", p.sample)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sample:
        return empty
    books = fit_codebooks(np.array(sample), p)
    index = scratch.write(rows.mapInArrow(_encoder(books, p.beam, k), "vec_ids array<long>, v array<double>, codes binary, norm double, error double"), "index")
    parts = []
    for ids, queries in query_blocks(rows, every, p.block):
        parts.append(scratch.write(index.mapInArrow(_search(ids, queries, books, k, p.rerank), "query_id long, vec_id long, score double"), "found"))
    found = union_all(parts)
    return empty if found is None else best_of(found, k, False)
