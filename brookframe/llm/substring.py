"""Incremental exact removal of repeated passages with a log-structured fingerprint index.

Any two equal windows of `window` words select the same anchor, the least hash among the window's `gram`-word
grams, at the same place. So a document is written as one row per anchor: the anchor's hash `h` (8 words), and `s1`, `s2`,
a 128-bit BLAKE2b digest of all the words of the windows that select it (its segment). The index holds, in immutable runs
sorted by h, how often each segment occurs and one place where it does. Each new batch is merge-joined with all runs on h;
what meets is verified by the digest of the segment's words; the batch becomes a run, and runs of one level are compacted.

A segment seen twice has all its windows seen twice. Where one h has several segments, passages begin or end: only there the
windows themselves are read, in one place for each segment, and compared by the digests of their words.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, delete, lean
from .spread import heavy_keys, spread_join
from .words import SPACE, split_words, text_slices, window_hashes, word_hashes


@dataclass(frozen=True)
class Passages:
    """window: words of a repeated passage; gram: words of an anchor. window - gram + 1 (at most 60) grams compete.

    batches: how many batches one table is added to the index in; tier: so many runs of one level are compacted to one of the next.
    """

    window: int = 35
    gram: int = 8
    batches: int = 2
    tier: int = 4

    @property
    def span(self) -> int:
        return self.window - self.gram + 1


@dataclass
class Words:
    """A text's words joined by one space, where each starts and ends there, and their hashes."""

    text: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray


def _digests(words: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Two longs for each run of words [first, last): a digest of the words, joined by one space."""
    raw, size = memoryview(words.text), 16
    out = [hashlib.blake2b(raw[a:b], digest_size=size).digest() for a, b in zip(words.starts[first].tolist(), words.ends[last - 1].tolist(), strict=True)]
    return np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)


def _anchors(words: Words, p: Passages) -> tuple[np.ndarray, ...]:
    """(hash of the anchor, s1, s2, first window that selects it, number of such windows) for one text."""
    n = len(words.starts) - p.window + 1
    if n < 1:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    at = np.arange(len(words.starts) - p.gram + 1)
    grams = window_hashes(words.hashes, at, at + p.gram)
    chosen = np.lib.stride_tricks.sliding_window_view(grams, p.span).argmin(axis=1) + np.arange(n)
    # the leftmost least gram only moves right, so the windows of one anchor are consecutive
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    count = np.diff(np.r_[first, n])
    found = _digests(words, first, first + count - 1 + p.window)
    return grams[chosen[first]].view(np.int64), found[:, 0], found[:, 1], first, count


_ADDED = ("n_words", "n_removed", "kept_sha256", "kept_text")
_TO_SPACE = bytes(32 if SPACE[i] else i for i in range(256))


def _documents(column: pa.Array, hashed: bool = True) -> Iterator[Words]:
    for _, buf, offs in text_slices(column):
        starts, ends, first = split_words(buf, offs)
        hashes = word_hashes(buf, starts, ends) if hashed else starts
        plain = buf.tobytes().translate(_TO_SPACE)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if a == b:
                yield Words(b"", starts[:0], ends[:0], hashes[:0])
                continue
            own, size = plain[starts[a] : ends[b - 1]], ends[a:b] - starts[a:b]
            if int(size.sum()) + b - a - 1 != len(own):
                own = b" ".join(own.split())
            begin = np.cumsum(size + 1) - size - 1
            yield Words(own, begin, begin + size, hashes[a:b])


def _find_anchors(p: Passages):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for i, words in enumerate(_documents(batch.column(2))):
                found = _anchors(words, p)
                if len(found[0]):
                    rows.append(np.full(len(found[0]), i))
                    parts.append(found)
            if not rows:
                continue
            at = pa.array(np.concatenate(rows))
            h, s1, s2, first, count = (np.concatenate(x) for x in zip(*parts, strict=True))
            # up to span windows: place in the text and their number share one long
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, (h, s1, s2, first * 64 + count))], ["k1", "k2", "h", "s1", "s2", "place"])

    return find


def _expand(p: Passages):
    """The windows of each listed anchor: (two longs of the window's words, h, s1, s2, which, n)."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words, listed in zip(_documents(batch.column(0), False), batch.column(1).to_pylist(), strict=True):
                place = np.array([x["place"] for x in listed], np.int64)
                count = place % 64
                which = np.concatenate([np.arange(c) for c in count])
                first = np.repeat(place // 64, count) + which
                found = _digests(words, first, first + p.window)
                out.append((found[:, 0], found[:, 1], *(np.repeat(np.array([x[k] for x in listed], np.int64), count) for k in ("h", "s1", "s2")), which, np.repeat(np.array([x["n"] for x in listed], np.int64), count)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["w1", "w2", "h", "s1", "s2", "which", "n"])

    return expand


def _remove(p: Passages, texts: bool):
    """Each text with the listed windows' words taken out. listed: (place, mask), bit i of mask for the i-th window of the anchor."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, sha, kept = [], [], [], []
            for own, listed in zip(_documents(batch.column("text"), False), batch.column("listed").to_pylist(), strict=True):
                n = len(own.starts)
                edge = np.zeros(n + 1, np.int64)
                for x in listed or ():
                    first, count = divmod(x["place"], 64)
                    at = first + np.flatnonzero([x["mask"] >> i & 1 for i in range(count)])
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + p.window, -1)
                stay = np.cumsum(edge[:-1]) == 0
                text = own.text if stay.all() else b" ".join([w for w, s in zip(own.text.split(), stay.tolist(), strict=True) if s])
                total.append(n)
                gone.append(n - int(stay.sum()))
                sha.append(hashlib.sha256(text).hexdigest())
                kept.append(text)
            out = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            if texts:
                out = [batch.column("text"), *out, pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *out], ["row", *["text"] * texts, *_ADDED[: 3 + texts]])

    return remove


_KEY = ["h", "s1", "s2"]
_RUN = "h long, s1 long, s2 long, n long, at struct<k1: long, k2: long, place: long>"


class FingerprintIndex:
    """Runs of (h, s1, s2, n, at): how often each segment occurs in all batches so far, and one place of it. Each run is sorted by h.

    path: a folder where the index stays, to be opened again; without it, the index belongs to the scratch. A list of the live
    runs is written anew after each change, so a run that was not finished, or has been compacted, is not read.
    """

    def __init__(self, scratch: Scratch, path: str | None = None, p: Passages = Passages()):
        self.scratch, self.p, self.root = scratch, p, (path or f"{scratch.root}/index").rstrip("/")
        spark = scratch.spark
        self.names: list[str] = []
        lists = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/lists")
        if lists.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(lists):
            rows = spark.read.schema("version long, names array<string>").parquet(f"{self.root}/lists").orderBy(F.desc("version")).limit(1).collect()
            self.version, self.names = (rows[0].version, list(rows[0].names)) if rows else (0, [])
        else:
            self.version = 0

    @property
    def runs(self) -> list[DataFrame]:
        return [self.scratch.spark.read.schema(_RUN).parquet(f"{self.root}/{n}") for n in self.names]

    def _write(self, rows: DataFrame, level: int) -> str:
        name = f"run-{level}-{uuid.uuid4().hex[:12]}"
        self.scratch.write(rows.sortWithinPartitions("h"), name, path=f"{self.root}/{name}")
        return name

    def _publish(self, names: list[str]) -> None:
        self.names, self.version = names, self.version + 1
        one = self.scratch.spark.createDataFrame([(self.version, names)], "version long, names array<string>")
        one.coalesce(1).write.mode("append").parquet(f"{self.root}/lists")

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.min("at").alias("at"))

    def add(self, anchors: DataFrame) -> DataFrame:
        """Add a batch; returns (h, s1, s2, n, at, several) of all segments, old and new, whose h occurs in the batch and twice in all.

        n counts all batches so far; several: that h has more than one segment.
        """
        spark, old = self.scratch.spark, None
        name = self._write(self._summed(anchors.select(*_KEY, F.lit(1).cast("long").alias("n"), F.struct("k1", "k2", "place").alias("at"))), 0)
        run = spark.read.schema(_RUN).parquet(f"{self.root}/{name}")
        for r in self.runs:
            old = r if old is None else old.union(r)
        if old is None:
            known = run
        else:
            # the merge join of the sorted runs with the batch: only what shares an anchor with it is looked at
            met = old.join(run.select("h").distinct().hint("merge"), "h", "left_semi")
            known = self.scratch.write(self._summed(run.union(met)), "known")
        twice = known.groupBy("h").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("segments")).where("_n > 1").select("h", "segments")
        twice = self.scratch.write(twice, "twice")
        heavy = heavy_keys(twice, ["h"], twice.agg(F.coalesce(F.sum("segments"), F.lit(0))).first()[0], "segments")
        found = spread_join(known, twice.select("h", (F.col("segments") > 1).alias("several")).hint("merge"), ["h"], heavy, ["s1"])
        found = self.scratch.write(found.select(*_KEY, "n", "at", "several"), "met")
        self.scratch.drop(known, twice)
        self._publish([*self.names, name])
        self.compact()
        return found

    def compact(self) -> None:
        """Merge the runs of a level to one of the next wherever p.tier or more have come together; then the old ones go."""
        level = 0
        while True:
            own = [n for n in self.names if int(n.split("-")[1]) == level]
            if not own:
                if not any(int(n.split("-")[1]) > level for n in self.names):
                    return
            elif len(own) >= self.p.tier:
                rows = None
                for n in own:
                    run = self.scratch.spark.read.schema(_RUN).parquet(f"{self.root}/{n}")
                    rows = run if rows is None else rows.union(run)
                merged = self._write(self._summed(rows), level + 1)
                self._publish([*[n for n in self.names if n not in own], merged])
                for n in own:
                    delete(self.scratch.spark, f"{self.root}/{n}")
            level += 1


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """(k1, k2, text): two hashes of the text stand for it."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))


def find_anchors(docs: DataFrame, text_col: str = "text", p: Passages = Passages()) -> DataFrame:
    """(k1, k2, h, s1, s2, place) of every anchor of every text."""
    return _keyed(docs, text_col).mapInArrow(lean(_find_anchors(p)), "k1 long, k2 long, h long, s1 long, s2 long, place long")


def repeated_windows(docs: DataFrame, scratch: Scratch, text_col: str = "text", p: Passages = Passages(), index: FingerprintIndex | None = None, history: DataFrame | None = None) -> tuple[DataFrame, list[tuple]]:
    """(k1, k2, listed): for each distinct text, the places and masks of its windows that start anywhere else too; and the (k1, k2) of very many rows."""
    anchors = scratch.write(find_anchors(docs, text_col, p), "anchors")
    index = index or FingerprintIndex(scratch, p=p)
    met = [index.add(anchors.where(F.pmod("k2", F.lit(p.batches)) == i)) for i in range(p.batches)]
    every = met[0]
    for m in met[1:]:
        every = every.union(m)
    # the last batch that met a segment knows most of it
    repeated = every if len(met) == 1 else scratch.write(every.groupBy(*_KEY).agg(F.max("n").alias("n"), F.min("at").alias("at"), F.max("several").alias("several")), "repeated")
    total = anchors.count()
    often = heavy_keys(repeated, _KEY, total)
    keyed = _keyed(docs, text_col)
    copies = heavy_keys(keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")), ["k1", "k2"], docs.count())
    # where an h has several segments, their windows are looked at one by one, in one place for each segment
    listed = repeated.where("several").select(*_KEY, "n", "at.*").groupBy("k1", "k2").agg(F.collect_list(F.struct("place", *_KEY, "n")).alias("listed"))
    listed = scratch.write(listed, "listed")
    texts = keyed if history is None else keyed.union(_keyed(history, text_col))
    texts = texts.withColumn("deal", F.monotonically_increasing_id()) if copies else texts  # rows of heavy texts are alike: it does not matter which task gets them
    windows = spread_join(texts, listed, ["k1", "k2"], copies, ["deal"])
    windows = scratch.write(windows.select("text", "listed").mapInArrow(lean(_expand(p)), "w1 long, w2 long, h long, s1 long, s2 long, which long, n long"), "windows")
    # copies of a text list the same anchors; each of their windows has n > 1 already, so counting them again changes nothing
    shared = scratch.write(windows.groupBy("w1", "w2").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("n")).where("_n > 1").select("w1", "w2", "n"), "shared")
    common = heavy_keys(shared, ["w1", "w2"], shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    masks = spread_join(windows, shared.select("w1", "w2"), ["w1", "w2"], common, ["s1"]).groupBy(*_KEY).agg(F.expr("bit_or(shiftleft(1L, cast(which as int)))").alias("mask"))
    whole = repeated.where("n > 1").select(*_KEY, F.lit(-1).cast("long").alias("mask"))
    marks = scratch.write(whole.union(masks.join(whole, _KEY, "left_anti").select(*_KEY, "mask")), "marks")
    scratch.drop(windows, listed, shared)
    found = spread_join(anchors, marks, _KEY, often, ["k1", "place"]).groupBy("k1", "k2", "place").agg(F.bit_or("mask").alias("mask"))
    found = scratch.write(found.groupBy("k1", "k2").agg(F.collect_list(F.struct("place", "mask")).alias("listed")), "found")
    scratch.drop(anchors, marks, repeated, *met)
    return found, copies


def remove_repeats(docs: DataFrame, text_col: str = "text", p: Passages = Passages(), texts: bool = True, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and kept_text added (columns of these names in docs are replaced).

    Words are runs outside ASCII white space, unchanged. Each word that is covered by a window of p.window words
    whose word sequence also starts anywhere else in the column, the same document included, is removed; windows are
    judged on the input. kept_text holds the kept words joined by one space.

    index: one that has met the documents of `history` before; windows are then judged against these too, and the index
    goes on with docs. Only docs are changed and returned. Without it, docs alone are judged.

    A null or empty text has no words: 0, 0, the hash of nothing and an empty kept_text. Texts shorter than the window
    are kept whole. Repeated rows count as repeats of each other. A text of any length is handled whole, in the
    memory of one task. An empty table gives an empty result. Other columns pass through, whatever their names.
    texts=False leaves out the text and kept_text.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    found, copies = repeated_windows(docs, scratch, text_col, p, index, history)
    text = F.col(f"`{text_col}`").cast("string")
    keep = [c for c in docs.columns if c not in _ADDED]
    others = [F.col(f"`{c}`") for c in keep if c != text_col] or [F.lit(None).cast("int").alias("none")]
    own = docs.select(F.struct(*others).alias("row"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    if copies:
        own = own.withColumn("deal", F.xxhash64("row"))
    joined = spread_join(own, found, ["k1", "k2"], copies, ["deal"], "left").select("row", "text", "listed")
    fields = T.StructType([own.schema["row"], *[T.StructField("text", T.StringType())] * texts, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), *[T.StructField("kept_text", T.StringType())] * texts])
    out = joined.mapInArrow(lean(_remove(p, texts)), fields)
    back = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in keep if texts or c != text_col]
    return out.select(*back, *_ADDED[: 3 + texts])
