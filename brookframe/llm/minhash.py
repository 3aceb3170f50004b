"""MinHash near-duplicate detection with exact confirmation on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch, lean
from .spread import heavy_keys, spread_join
from .words import LOWER, SPACE, exact_sets, mix, split_words, text_slices, window_hashes, word_hashes


@dataclass(frozen=True)
class NearDup:
    """Parameters. 64 bands of 6 minima miss a pair at similarity 0.75 with probability (1 - 0.75**6)**64 = 4e-6."""

    words: int = 5
    percent: int = 75
    bands: int = 64
    rows: int = 6
    kept_minima: int = 128
    slack: float = 0.25  # signature estimates below percent/100 - slack (over six deviations) are not confirmed
    seed: int = 7
    block: int = 64  # buckets above this size are compared by blocks of members

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        n = self.bands * self.rows
        return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


_PLAIN = bytes(32 if SPACE[i] else LOWER[i] for i in range(256))


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Each text's words, in lower case and joined by one space, and the sorted distinct 64-bit hashes of its shingles."""
    for _, buf, offs in text_slices(column):
        raw, buf = buf.tobytes().translate(_PLAIN), LOWER[buf]
        starts, ends, first = split_words(buf, offs)
        words = word_hashes(buf, starts, ends)
        # one window of k words from each word on that has so many after it in its text
        at = np.arange(max(0, len(words) - k + 1))
        every = window_hashes(words, at, at + k)
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if b - a >= k:
                found = np.unique(every[a : b - k + 1])
            else:
                found = window_hashes(words[a:b], np.array([0]), np.array([b - a])) if b > a else np.zeros(0, np.uint64)
            yield b" ".join(raw[offs[i] : offs[i + 1]].split()), found


def minima(shingles: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The least value of each universal hash over the set; long sets go in blocks."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = None
    for i in range(0, len(x), 512):
        block = np.multiply.outer(mult, x[i : i + 512])
        block += add[:, None]
        low = block.min(axis=1)
        least = low if least is None else np.minimum(least, low)
    return least


_SIGNED = "doc_id long, t long, s1 long, s2 long, n_shingles long, sig binary, bands array<long>"


def _signer(p: NearDup):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult, add = p.hashes()
        weights = np.random.default_rng(p.seed + 1).integers(0, 1 << 63, (p.bands, p.rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        salt = mix(np.arange(1, p.bands + 1, dtype=np.uint64))
        for batch in batches:
            s1, s2, n, sig, bands = [], [], [], [], []
            for words, s in shingle_sets(batch.column(1), p.words):
                n.append(len(s))
                digest = blake2b(words, digest_size=16).digest()
                s1.append(int.from_bytes(digest[:8], "little", signed=True))
                s2.append(int.from_bytes(digest[8:], "little", signed=True))
                if len(s):
                    least = minima(s, mult, add)
                    sig.append((least[: p.kept_minima] & np.uint32(255)).astype(np.uint8).tobytes())
                    rows = least.reshape(p.bands, p.rows).astype(np.uint64)
                    bands.append(mix((rows * weights).sum(axis=1, dtype=np.uint64) ^ salt).view(np.int64))
                else:
                    sig.append(b"")
                    bands.append(np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), keys], ["doc_id", "t", "s1", "s2", "n_shingles", "sig", "bands"])

    return sign


def _pair_sets(left: pa.Array, right: pa.Array, k: int, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The exact sets of each pair of texts; pairs of about `most` bytes are read at once, and a text of several pairs once among them."""
    n = len(left)
    size = np.cumsum([0, *(sum(x or 0 for x in both) for both in zip(pc.binary_length(left).to_pylist(), pc.binary_length(right).to_pylist(), strict=True))])
    whole, i = pa.concat_arrays([left, right]), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(size, size[i] + most, "right")) - 1)
        at = np.arange(i, j)
        texts = whole.take(pa.array(np.stack([at, at + n], axis=1).ravel())).fill_null("").dictionary_encode()
        sets, number = exact_sets(texts.dictionary, k), texts.indices.to_pylist()
        yield from ((sets[x], sets[y]) for x, y in zip(number[::2], number[1::2], strict=True))
        i = j


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _linked_pairs(x: list[np.ndarray], y: list[np.ndarray], percent: int, most: int = 1 << 22) -> np.ndarray:
    """Rows (i, j) for all x[i] and y[j] that are linked: the numbers in sets of both sides give two 0-1 matrices, whose product has
    the sizes of all intersections. Matrices have about `most` places at once."""
    common = np.intersect1d(np.concatenate(x), np.concatenate(y))
    place = np.full(max(int(s[-1]) for s in (*x, *y)) + 1, -1)
    place[common] = np.arange(len(common))
    both, step = np.zeros((len(x), len(y)), np.int64), max(1, most // (len(x) + len(y)))
    found = [[(at := place[s])[at >= 0] for s in sets] for sets in (x, y)]
    for i in range(0, len(common), step):
        sides = []
        for sets in found:
            side = np.zeros((len(sets), min(step, len(common) - i)), np.float32)
            for row, at in zip(side, sets, strict=True):
                row[at[(at >= i) & (at < i + step)] - i] = 1
            sides.append(side)
        both += (sides[0] @ sides[1].T).astype(np.int64)
    size = np.add.outer([len(s) for s in x], [len(s) for s in y])
    return np.argwhere(100 * both >= percent * (size - both))


def _confirmer(p: NearDup):
    least_share = p.percent / 100 - p.slack

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            good = np.zeros(n, bool)
            if n:
                sa, sb = batch.column("sig_a").to_pylist(), batch.column("sig_b").to_pylist()
                near = [np.count_nonzero(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)) / p.kept_minima >= least_share for x, y in zip(sa, sb, strict=True)]
                rows = pa.array(np.flatnonzero(near))
                for i, (x, y) in zip(rows.to_pylist(), _pair_sets(batch.column("text_a").take(rows), batch.column("text_b").take(rows), p.words), strict=True):
                    good[i] = _linked(x, y, p.percent)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b")], ["a", "b"])

    return confirm


def _blocks(left: DataFrame, texts: DataFrame, scratch: Scratch, p: NearDup) -> DataFrame:
    """Links between members of large buckets that are in different components: (a, b), enough to connect them.

    Members with the same largest bucket, and of a large component there, form blocks of about p.block texts of sizes in one
    class, each class 100/percent times the last. Blocks that share a bucket, in the same class or neighbours (others
    cannot hold linked sets), are compared once as wholes, exactly, so rows are pairs of blocks and not of members.
    """
    step = math.log(100 / p.percent)
    home = left.groupBy("node", "c").agg(F.max(F.struct("size", "bucket")).alias("m")).select("node", "c", F.col("m.bucket").alias("home"))
    sizes = home.groupBy("home", "c").agg(F.count(F.lit(1)).alias("n"))
    kind = sizes.select("home", "c", "n", F.when(F.col("n") >= p.block, F.col("c")).alias("own"))
    room = kind.groupBy("home", "own").agg(F.ceil(F.sum("n") / p.block).alias("blocks"))
    placed = home.join(kind.drop("n"), ["home", "c"]).join(room.select(F.col("home").alias("h2"), F.col("own").alias("o2"), "blocks"), (F.col("home") == F.col("h2")) & F.col("own").eqNullSafe(F.col("o2")))
    placed = scratch.write(placed.select("node", "c", F.xxhash64("home", "own", F.pmod(F.xxhash64("node"), "blocks")).alias("block")), "placed")
    # a node with several texts is in the block of each one's class
    full = placed.join(texts, "node").withColumn("class", F.floor(F.log(F.greatest("n_shingles", F.lit(1)).cast("double")) / step).cast("int"))
    full = full.groupBy("block", "class").agg(F.collect_list(F.struct("node", "c", "text")).alias("rows"))
    full = scratch.write(full, "blocks")
    classes = full.select("block", "class")
    shared = left.select("bucket", "node").join(placed.select("node", "block"), "node").select("bucket", "block").distinct().join(classes, "block")
    x, y = (shared.select("bucket", F.col("block").alias(n), F.col("class").alias(f"{n}_class")) for n in "xy")
    near = (F.col("x") < F.col("y")) | ((F.col("x") == F.col("y")) & (F.col("x_class") <= F.col("y_class")))
    pairs = x.join(y, "bucket").where(near & (F.abs(F.col("x_class") - F.col("y_class")) <= 1)).drop("bucket").distinct()
    one, other = (full.select(F.col("block").alias(n), F.col("class").alias(f"{n}_class"), F.col("rows").alias(side)) for n, side in (("x", "left"), ("y", "right")))
    return pairs.join(one, ["x", "x_class"]).join(other, ["y", "y_class"]).select("left", "right").mapInArrow(lean(_block_confirmer(p)), "a long, b long")


def _block_confirmer(p: NearDup):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                group = {r["node"]: r["c"] for r in left + right}
                if len(set(group.values())) < 2:
                    continue
                sets = exact_sets(pa.array([r["text"] for r in left + right], pa.string()), p.words)
                for i, j in _linked_pairs(sets[: len(left)], sets[len(left) :], p.percent).tolist():
                    n, m = left[i]["node"], right[j]["node"]
                    if group[n] != group[m]:
                        a.append(n)
                        b.append(m)
                        old, new = group[m], group[n]
                        group = {k: new if v == old else v for k, v in group.items()}
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return confirm


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: NearDup = NearDup()) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and split at ASCII white space; a document's set holds its distinct p.words-word
    shingles (all its words as one shingle if it has fewer). Documents with 100*|A and B| >= percent*|A or B| are
    linked; component_id is the smallest doc_id reachable, kept tells whether that is the document itself.

    Texts of the same words are first joined in a class, by a 128-bit digest of the words, so copies never meet each other.
    Classes that share a band bucket are candidates; links are confirmed on the sets of the words themselves, not of hashes: each is confirmed against its most frequent bucket centre, then against all its centres
    in other components, and at last against every member of its buckets that is still in another component, so
    that no link between two components goes untested; large buckets are compared block by block. Where a class, a bucket or
    a centre has more than a thousandth of all rows, its rows are dealt to many tasks. A text of any length is handled whole,
    in the memory of one task.

    Nulls: a null or empty text, or one without words, has an empty set and links with nothing. A row with a null
    doc_id gets its n_shingles, a null component_id and kept true, and links nothing. Repeated rows get equal answers; rows of
    one doc_id with different texts are judged each by its text, and may be linked through the id. Other columns of docs, whatever their names, are not
    read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))
    signed = scratch.write(rows.mapInArrow(lean(_signer(p)), _SIGNED), "signed")
    real = signed.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.write(real.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "classes")
    copies = heavy_keys(classes, ["s1", "s2"], real.count())
    chosen = classes.select(F.col("node").alias("doc_id"), "s1", "s2")
    # rows of one id and one text are alike; the classes' nodes are distinct but for ids with several texts
    banded = real.join(chosen, ["doc_id", "s1", "s2"], "left_semi").select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket"))
    centre = (
        banded.groupBy("bucket")
        .agg(F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node"))).alias("c"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("n"))
        .where("lo <> hi")
        .select("bucket", F.col("c.node").alias("centre"), "n")
    )
    centre = scratch.write(centre, "centres")
    full = heavy_keys(centre, ["bucket"], centre.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    members = scratch.write(spread_join(banded, centre.drop("n"), ["bucket"], full, ["node"]).select("bucket", "node", "centre"), "members")

    candidates = members.select(F.col("node").alias("doc_id")).distinct()
    wanted = signed.where("n_shingles > 0").join(candidates, "doc_id", "left_semi").groupBy("doc_id", "t").agg(F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    texts = scratch.write(rows.join(wanted, ["doc_id", "t"]).select(F.col("doc_id").alias("node"), "text", "sig", "n_shingles"), "texts")
    stars = scratch.write(members.where("node <> centre").groupBy(F.col("node").alias("a"), F.col("centre").alias("b")).agg(F.count(F.lit(1)).alias("shared")), "stars")

    def hot(pairs: DataFrame) -> list[tuple]:
        return heavy_keys(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), ["b"], pairs.count())

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = scratch.write(pairs.select("a", "b"), "pairs")
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"), F.col("sig").alias("sig_a"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"), F.col("sig").alias("sig_b"))
        return spread_join(pairs.join(left, "a"), right, ["b"], hot(pairs), ["a"]).select("a", "b", "text_a", "text_b", "sig_a", "sig_b").mapInArrow(lean(_confirmer(p)), "a long, b long")

    def labelled(df: DataFrame, of: DataFrame, at: str, name: str, heavy: list[tuple] = (), by: str = "a") -> DataFrame:
        named = of.select(F.col("node").alias(at), F.col("component").alias("_found"))
        return spread_join(df, named, [at], heavy, [by], "left").withColumn(name, F.coalesce("_found", at)).drop("_found")

    # 1: each class and the centre it shares most buckets with
    best = stars.groupBy("a").agg(F.max(F.struct("shared", -F.col("b"))).alias("m")).select("a", (-F.col("m")[F.lit("col2")]).alias("b"))
    links = scratch.write(confirmed(best), "links")
    found = connected_components(links, scratch)
    # 2: all centres that are still elsewhere
    apart = labelled(labelled(stars.join(best, ["a", "b"], "left_anti"), found, "a", "ca"), found, "b", "cb", hot(stars)).where("ca <> cb")
    more = scratch.write(confirmed(apart), "links")
    found = connected_components(more, scratch, found)
    # 3: all members of a bucket that are still elsewhere
    within = labelled(members.select("bucket", "node"), found, "node", "c")
    mixed = within.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("bucket", "size")
    left = scratch.write(spread_join(within, mixed, ["bucket"], full, ["node"]), "mixed")
    small = left.where(F.col("size") <= p.block)
    x, y = small.select("bucket", F.col("node").alias("a"), F.col("c").alias("ca")), small.select("bucket", F.col("node").alias("b"), F.col("c").alias("cb"))
    tested = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = x.join(y, "bucket").where("ca < cb").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
    more = scratch.write(confirmed(rest), "links")
    large = left.where(F.col("size") > p.block)
    if not large.isEmpty():
        more = more.union(scratch.write(_blocks(large, texts, scratch, p), "links", 2))
    if not more.isEmpty():
        found = connected_components(more, scratch, found)

    of_class = labelled(classes, found, "node", "component_id").select("s1", "s2", "component_id")
    grouped = spread_join(signed.where("n_shingles > 0").select("doc_id", "s1", "s2", "n_shingles"), of_class, ["s1", "s2"], copies, ["doc_id"], "left")
    grouped = grouped.select("doc_id", "n_shingles", "component_id").union(signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long")))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return grouped.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: NearDup = NearDup()) -> DataFrame:
    """The rows of docs of which near_duplicates keeps the document; of rows with one doc_id, one stays.

    Rows with a null doc_id, and documents with a null or empty text, stay. Ties: the smallest doc_id of a group stays. Same
    columns, whatever their names; an empty table gives an empty result; texts of any length are handled whole.
    """
    found = near_duplicates(docs, id_col, text_col, p).where("kept and doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct()
    kept = docs.join(found, id_col, "left_semi")
    if not docs.where(F.col(f"`{id_col}`").isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
