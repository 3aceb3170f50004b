"""The ten operators against brute force, round trips and held-out labels, and on odd rows."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brookframe.llm import additive, hilbert, langid, minhash, mixing, packing, pivots, quality, queries, substring, toxicity, words
from brookframe.llm.labelled import bounded_sample, in_fold
from brookframe.llm.components import connected_components
from brookframe.llm.sample import least_hashed
from brookframe.llm.scratch import Scratch, checkpoint_dir, disposable
from brookframe.llm.spread import heavy_keys, spread_join

SMALL, MEDIUM, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"
WORD = r"[^\x20\x09-\x0D]+"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
FIELDS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, kept boolean, n_words long, words long, _id long, block long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, ""), (2, None), (3, "a b"), (3, "a b"), (None, "one two three four five six"), (5, LONG), (6, " \t\n "), (7, "one two three four five six"), (8, "ÀÉ ß’s don't 漢字 🙂"), (9, "12 34")]
    return spark.createDataFrame([(i, t, None if i == 7 else "en", None if i == 8 else "s", 1, 0.5, "r", True, 1, 1, 1, 1) for i, t in rows], FIELDS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], FIELDS)


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark, folder):
    return {r.doc_id: r.text for r in table(spark, folder, "documents").select("doc_id", "text").collect()}


# 1


def test_quality_held_out(spark):
    out = queries.op1_quality_classifier(spark, MEDIUM)
    assert out.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = out.join(table(spark, MEDIUM, "labels"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    z = rng.normal(size=4000) * 5
    y = (rng.random(4000) < 1 / (1 + np.exp(-z / 4))).astype(float)
    assert 3 < quality.fit_temperature(z, y, np.ones(4000)) < 5.5


def test_quality_odd_rows(spark, odd, none):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    model = quality.fit_quality(docs, labels)
    rows = quality.score_quality(odd, model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows) and not next(r for r in rows if r.doc_id is None).held_out
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    assert quality.score_quality(none, model).count() == 0 and quality.fit_quality(docs, labels.limit(0)) is None
    assert {r.score for r in quality.score_quality(odd, None).collect()} == {0.5}
    assert quality.keep_good(odd, model).columns == odd.columns and quality.keep_good(odd, None).count() == 10


# 2


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = hilbert.curve_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_shards(spark, tmp_path):
    own, docs = texts(spark, SMALL), table(spark, SMALL, "documents")
    sharded = queries.op2_hilbert_sharding(spark, SMALL)
    rows = sharded.collect()
    assert sorted(r.doc_id for r in rows) == sorted(own)
    by = collections.defaultdict(list)
    for r in rows:
        raw = own[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        by[r.shard].append((r.slot, r.curve_index))
    assert sorted(by) == list(range(40)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in by.values())
    ends = [(min(c for _, c in by[i]), max(c for _, c in by[i])) for i in range(40)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert hilbert.manifest(sharded, ["size", "source"]).count() == 40
    hilbert.write_shards(docs, sharded, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(own)


def test_shards_of_strings_with_a_common_prefix(spark):
    rows = [(i, f"text {i}", f"https://site{i % 40:02}.org", "en") for i in range(400)]
    found = hilbert.hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), dims=("source",)).collect()
    cell = {r.source: r.curve_index for r in found}
    assert len(set(cell.values())) == 40 and [r.source for r in sorted(found, key=lambda r: (r.shard, r.slot))] == sorted(r.source for r in found)


def test_strings_are_cut_by_all_rows(spark):
    n, values = 30_000, sorted(["common"] * 9000 + [f"v{i:05}" for i in range(21_000)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, source string")
    edges = sorted({values[n * i // 127] for i in range(127)})
    found = hilbert.hilbert_order(df, ["source"]).collect()
    assert [r.curve_index for r in found] == np.searchsorted(np.array(edges, object), [r.source for r in found], "right").tolist()


def test_shards_odd_rows(odd, none):
    rows = hilbert.hilbert_shards(odd).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(i, 0) for i in range(10)]
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (1, 2)} == {(16, 0)}
    assert hilbert.hilbert_shards(none).count() == 0


# 3


def pieces_of(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    return by


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json"))
    own = texts(spark, SMALL)
    packed = packing.pack(table(spark, SMALL, "documents"), with_ids=True)
    rows = packed.collect()
    for doc, pieces in pieces_of(rows).items():
        ids = np.array([*t.encode(own[doc] or "", add_special_tokens=False).ids, 0], "<u4")
        pieces.sort(key=lambda r: r.piece)
        assert b"".join(r.ids for r in pieces) == ids.tobytes() and all(r.length == 2048 for r in pieces[:-1])
        assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.start == 2048 * r.piece for r in pieces)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and sum(n for _, n in parts) <= 2048
    assert len(sequences) <= 1.02 * sum(r.length for r in rows) / 2048 + 1
    assert packing.sequences(packed).where(F.octet_length("ids") > 4 * 2048).count() == 0


def test_word_tokens_are_those_of_whole_texts():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    odd = ["", "  ", "a<|endoftext|>b c", "X<|STARTOFTEXT|> <|startoftext|>", "don't ’s it's Ünïcödé ΣΑΣ x y\x1cz", "é ́x ÀÉ. É,, ÿ× ª", "a1b2 3.14 (x)… --y", "漢字 🙂 ok"]
    for keep in (2, 1000):
        got = packing.WordTokens(path, keep).of([x.encode() for x in odd])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in odd]


LENGTHS = {
    "any": lambda r: r.integers(1, 2049, 1500),
    "one": lambda r: r.integers(1, 2049, 1),
    "thirds": lambda r: r.integers(600, 760, 3000),
    "middle": lambda r: r.integers(300, 1400, 6000),
    "documents": lambda r: np.clip(r.lognormal(5.5, 1.0, 4000), 1, 2048).astype(int),
    "six kinds": lambda r: r.choice([1025, 700, 324, 512, 513, 340], 3000),
}


@pytest.mark.parametrize("kind", LENGTHS)
def test_program_against_best_fit(kind):
    h = dict(collections.Counter(LENGTHS[kind](np.random.default_rng(1)).tolist()))
    plan, held = packing.solve(h), collections.Counter()
    for filling, times in plan:
        assert sum(x * c for x, c in filling) <= 2048
        for x, c in filling:
            held[x] += c * times
    assert held == h
    ours, plain = (sum(t for _, t in q) for q in (plan, packing.best_fit(h, 2048)))
    assert ours <= plain
    if kind in ("thirds", "middle", "six kinds"):
        assert ours < plain
    # the program itself: every length covered once at most, and almost
    use = packing.linear_program(h, packing.Packing())
    cover = collections.Counter()
    for f, x in use.items():
        for k, c in f:
            cover[k] += c * x
    assert all(cover[k] <= n * (1 + 1e-9) for k, n in h.items()) and sum(cover.values()) >= 0.8 * sum(h.values())


def test_no_pieces():
    assert packing.solve({}) == []


def test_packing_odd_rows(odd, none):
    rows = packing.pack(odd).collect()
    by = pieces_of(rows)
    assert [(r.length, r.start) for r in by[1] + by[2] + by[6]] == [(1, 0)] * 3 and len(by[3]) == 2 and len(by[None]) == 1 and len(by[5]) > 1
    assert packing.pack(none).count() == 0


# 4


def components(own, k=5, percent=75):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in own.items():
        w = re.findall(WORD, (t or "").translate(lower))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(own), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in own}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("block", [64, 2])
def test_near_duplicates(spark, block):
    docs = table(spark, SMALL, "documents")
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
    near = [(10_000 + i, " ".join([*words * 3, f"z{i}", *(f"y{i}{j}" for j in range(i % 9))])) for i in range(24)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    own = {r.doc_id: r.text for r in more.collect()}
    want, sizes = components(own)
    rows = minhash.near_duplicates(more, p=minhash.NearDup(block=block)).collect()
    assert {r.doc_id: r.component_id for r in rows} == want and {r.doc_id: r.n_shingles for r in rows} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows) and len(set(want.values())) < len(own)


def test_linked_pairs():
    rng = np.random.default_rng(4)
    base = np.arange(300)
    x, y = ([np.unique(np.r_[rng.choice(base, int(rng.integers(200, 300)), replace=False), rng.integers(300, 500, 20)]) for _ in range(n)] for n in (9, 14))
    x.append(y[3])
    want = [[i, j] for i, s in enumerate(x) for j, t in enumerate(y) if minhash._linked(s, t, 75)]
    assert 0 < len(want) < len(x) * len(y)
    for most in (1 << 22, 100):
        assert minhash._linked_pairs(x, y, 75, most).tolist() == want


def test_pairs_of_one_text_read_it_once(monkeypatch):
    read, plain = [], minhash.exact_sets
    monkeypatch.setattr(minhash, "exact_sets", lambda column, k: read.append(len(column)) or plain(column, k))
    left, right = ["one two three four five six"] * 10, [f"one two three four five six {i}" for i in range(10)]
    pairs = list(minhash._pair_sets(pa.array(left), pa.array(right), 5))
    assert sum(read) == 11 and [(len(a), len(b), len(np.intersect1d(a, b))) for a, b in pairs] == [(2, 3, 2)] * 10


def test_components_that_are_stars_take_one_write(spark):
    scratch = Scratch(spark, "stars")
    edges = spark.createDataFrame([(1, 5), (1, 7), (3, 1), (10, 12), (10, 10), (None, 4)], "a long, b long")
    found = {r.node: r.component for r in connected_components(edges, scratch).collect()}
    assert found == {1: 1, 3: 1, 5: 1, 7: 1, 10: 10, 12: 10} and len(scratch.paths) == 2
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(40, 41)], "a long, b long")
    assert {r.node: r.component for r in connected_components(chain, scratch).collect()} == {i: 0 for i in range(31)} | {40: 40, 41: 40}
    scratch.close()


def test_near_duplicates_odd_rows(odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in rows) == [
        (0, 2, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (3, 1, 3, True), (5, rows and max(r.n_shingles for r in rows), 5, True), (6, 0, 6, True), (7, 2, 7, True), (8, 1, 8, True), (9, 1, 9, True)]
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == 9 and minhash.drop_near_duplicates(none).count() == 0


def test_spread_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(40)] + [(None, 1)], "k string, v int")
    right = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(0, 40, 2)), ("other", 2)], "k string, w int")
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    heavy = heavy_keys(counts, ["k"], left.count())
    assert heavy == [("hot",)]
    for how in ("inner", "left"):
        joined = spread_join(left, right, ["k"], heavy, ["v"], how)
        assert joined.columns == left.join(right, "k", how).columns
        assert sorted(map(str, joined.collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, 201 + i) for i in range(600)]
    scratch = Scratch(spark, "test")
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long"), scratch).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[101] == 100 and all(found[200 + i] == 200 for i in range(601)) and len(found) == 41 + 2 + 601


# 5 and 10


def vectors(spark, n=400, dim=8):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=dim)]) for i in range(n)]
    odd = [(1000, None), (1100, [float("nan")] * dim), (1200, [1.0, None] + [0.0] * (dim - 2)), (1300, [0.0] * dim), (None, [1.0] * dim), (5, rows[5][1]), (1400, [1.0]), (1500, [float("inf")] * dim)]
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], "vec_id long, embedding array<float>, v string, score int")


def valid(df, nonzero):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect() if r.vec_id is not None and r.embedding is not None and None not in r.embedding and len(r.embedding) > 1]
    return [(i, v) for i, v in rows if np.isfinite(v).all() and (v.any() or not nonzero)]


def test_top_inner_products(spark):
    df = vectors(spark)
    rows = [(i, np.floor(v * 1024)) for i, v in valid(df, False)]
    got = collections.defaultdict(list)
    for r in pivots.top_inner_products(df, p=pivots.Pivots(pivots=5, block=2, chunk=7)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(got) == [0, 100, 200, 300, 1300]
    for q, v in rows:
        if q % 100 == 0:
            best = sorted(((-int(x @ v), i) for i, x in rows if i != q))[:10]
            assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert pivots.top_inner_products(df.limit(0)).count() == 0
    few = pivots.top_inner_products(df.where("vec_id < 4"))
    assert few.count() == 3 and few.schema.simpleString() == "struct<query_id:bigint,rank:int,vec_id:bigint,score:bigint>"


def test_nearest_neighbours_recall(spark):
    df = table(spark, LARGE, "embeddings")
    rows = valid(df, True)
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    got = collections.defaultdict(list)
    for r in additive.nearest_neighbours(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        best = [ids[i] for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hits, total = hits + len({r.vec_id for r in got[q]} & set(best)), total + len(best)
        assert all(abs(r.score - d[ids == r.vec_id][0]) < 1e-9 for r in got[q]) and [r.score for r in got[q]] == sorted(r.score for r in got[q])
    assert hits / total >= 0.9
    odd = additive.nearest_neighbours(vectors(spark))
    assert sorted({r.query_id for r in odd.collect()}) == [0, 100, 200, 300] and odd.where("vec_id = 1300").count() == 0
    assert additive.nearest_neighbours(vectors(spark).limit(0)).count() == 0 and additive.nearest_neighbours(vectors(spark).where("vec_id < 4")).count() == 3


def test_nearest_neighbours_of_copies(spark):
    rng = np.random.default_rng(4)
    copy, near = rng.normal(size=(2, 16))
    x = np.concatenate([rng.normal(size=(2000, 16)), np.tile(copy, (1500, 1)), near + 1e-4 * rng.normal(size=(1500, 16))])
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(0, copy.tolist())] * 30, "vec_id long, embedding array<double>").coalesce(1)
    x, ids = np.concatenate([x, np.tile(copy, (30, 1))]), np.r_[ids, [0] * 30]
    got = collections.defaultdict(list)
    for r in additive.nearest_neighbours(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = total = 0
    for q in range(100, len(x) - 30, 100):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        best = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hits, total = hits + sum(a == b for a, b in zip(got[q], best, strict=True)), total + 10
    assert hits == total == 490


def test_beam_search_is_not_worse_than_greedy():
    x = np.random.default_rng(0).normal(size=(600, 16)).astype(np.float32)
    books = additive.fit_codebooks(x, additive.Additive(books=4, entries=32))

    def error(beam):
        codes = additive.encode(x, books, beam)
        return ((x - sum(books[b][codes[:, b]] for b in range(4))) ** 2).sum()

    assert error(8) <= error(1)


# 6


def test_toxicity_held_out():
    c = duckdb.connect()
    rows = c.sql(f"select doc_id, text, toxic from '{LARGE}/labels.parquet' join '{LARGE}/documents.parquet' using (doc_id) order by doc_id").fetchall()
    fold = lambda r: zlib.crc32(str(r[0]).encode()) % 4 == 2
    p = toxicity.Toxicity()
    learn, held = [r for r in rows if not fold(r) and len(r[1]) <= p.fit_chars], [r for r in rows if fold(r)]
    bad = [r for r in learn if r[2]]
    learn = sorted(bad + [r for r in learn if not r[2]][:1500])
    y = np.array([r[2] for r in learn], float)
    model = toxicity.train(pa.array([r[1] for r in learn]), y, np.ones(len(y)), p)
    score, label = model.scores(pa.array([r[1] for r in held])), np.array([r[2] for r in held])
    assert (score[label == 1][:, None] > score[label == 0]).mean() > 0.95


def test_toxicity_scores_every_offset():
    rng, p = np.random.default_rng(5), toxicity.Toxicity(steps=20)
    passage = [f"vile{c}" for c in "abcdefghijklmnop"]
    plain = lambda n: [f"word{i}" for i in rng.integers(0, 200, n)]
    made = [" ".join([*plain(30), *(passage if i % 2 else []), *plain(30)]) for i in range(120)]
    y = np.array([i % 2 for i in range(120)], float)
    model = toxicity.train(pa.array(made), y, np.ones(len(y)), p)
    _, buf, offs = next(iter(toxicity.text_slices(pa.array([" ".join(passage)]))))
    alone = model.worst(buf, offs)[0]
    before, after = plain(40), plain(40)
    for place in range(40):
        text = " ".join([*before[:place], *passage, *after, ""])
        _, buf, offs = next(iter(toxicity.text_slices(pa.array([text, "short one", ""]))))
        words = model.net.known(toxicity.read_words(buf, offs, p))
        at, _, own = toxicity.windows_of(words.first, p)
        rows, mask = np.r_[words.types, len(words.bucket)][at], (at >= 0).astype(np.float32)
        each = model.net.forward(model.net.project(np.r_[model.net.inputs(words), np.zeros((1, p.dim), np.float32)]), rows, mask)[0]
        got = model.worst(buf, offs)
        assert got[0] >= alone - 1e-4 and np.allclose(got, np.maximum.reduceat(each, own[:-1]), atol=1e-4) and (np.diff(own) == [place + 41, 1, 1]).all()


def test_toxicity_attends_where_it_matters():
    rng, p = np.random.default_rng(7), toxicity.Toxicity()
    texts = [" ".join(f"word{i}" for i in rng.integers(0, 3000, n)) for n in (4000, 0, 3, 16, 900, 5000, 17)] + ["z" * 90 + " " + "y" * 40 + " ab"]
    _, buf, offs = next(iter(toxicity.text_slices(pa.array(texts))))
    raw = toxicity.read_words(buf, offs, p)
    net = toxicity.Network(p, np.unique(raw.bucket), np.unique(raw.grams)[::2])
    net.w = {k: (4 * v).astype(np.float32) for k, v in net.w.items()}
    words = net.known(raw)
    # inputs: means of n-grams, those of very long words too
    inputs = net.inputs(words)
    for i, (a, b) in enumerate(zip(words.gram_first[:-1], words.gram_first[1:], strict=True)):
        mean = net.w["gram"][words.grams[a:b]].mean(axis=0) if b > a else 0
        assert np.allclose(inputs[i], net.w["word"][words.bucket[i]] + mean, atol=1e-5)
    start, text, own = toxicity.window_starts(words.first, p)
    end = words.first[1:][text]
    every, some = net.logits(words, start, end), net.logits(words, start, end, text)
    assert np.isfinite(every).all() and 0 < np.isinf(some).mean() < 1
    assert np.allclose(some[np.isfinite(some)], every[np.isfinite(some)], atol=1e-4)
    assert np.allclose(np.maximum.reduceat(some, own[:-1]), np.maximum.reduceat(every, own[:-1]), atol=1e-4)


def test_toxicity_numbers_of_many():
    rng = np.random.default_rng(8)
    for vocabulary in (np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)), np.array([5, 7, 1 << 63], np.uint64)):
        hashes = np.r_[rng.choice(vocabulary, 70_000), rng.integers(0, 1 << 63, 1000).astype(np.uint64), vocabulary[[0, -1]]]
        want = {int(x): i for i, x in enumerate(vocabulary)}
        assert toxicity._number(hashes, vocabulary).tolist() == [want.get(int(x), len(vocabulary)) for x in hashes]


def test_toxicity_gradients():
    p = toxicity.Toxicity(dim=3, hidden=2, window=4, stride=3)
    _, buf, offs = next(iter(toxicity.text_slices(pa.array(["aa bb cc dd ee", "b dd aa", ""]))))
    raw = toxicity.read_words(buf, offs, p)
    net = toxicity.Network(p, np.unique(raw.bucket), np.unique(raw.grams))
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    at, _, _ = toxicity.windows_of(raw.first, p)
    assert at.tolist() == [[0, 1, 2, 3], [3, 4, -1, -1], [5, 6, 7, -1], [-1, -1, -1, -1]]
    words, rows, mask = toxicity._subset(net.known(raw), at)
    y, ones = np.array([1.0, 0, 1, 0]), np.ones(4)

    def loss():
        z = net.forward(net.project(net.inputs(words)), rows, mask.astype(float))[0]
        return (np.logaddexp(0, z) - y * z).mean()

    grads = net.gradients(words, rows, mask.astype(float), y, ones)
    for k, v in net.w.items():
        if v.shape:
            i = (0,) * v.ndim
            old, eps = v[i], 1e-3
            v[i] = old + eps
            up = loss()
            v[i] = old - eps
            down = loss()
            v[i] = old
            assert abs((up - down) / (2 * eps) - grads[k][i]) < 1e-4


def test_toxicity_odd_rows(spark, odd, none):
    model = toxicity.fit_toxicity(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"))
    rows = toxicity.score_toxicity(odd, model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows) and toxicity.score_toxicity(none, model).count() == 0
    assert toxicity.fit_toxicity(odd, spark.createDataFrame([], "doc_id long, toxic int")) is None


# 7


def test_languages(spark, odd, none):
    docs = table(spark, MEDIUM, "documents")
    model = langid.fit_languages(docs)
    out = langid.predict_languages(docs, model)
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows) and np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    by = {r.lang: r.text for r in docs.where("n_chars > 2000").collect()}
    both = spark.createDataFrame([(1, by["en"][:2000] + " " + by["de"][:2000])], "doc_id long, text string")
    assert {x.lang for x in langid.predict_languages(both, model).first().languages} == {"en", "de"}
    rows = langid.predict_languages(odd, model).collect()
    assert [r.lang_pred for r in rows if r.doc_id in (1, 2, 6, 9)] == ["und"] * 4 and all(0 <= r.score <= 1 for r in rows) and len(rows) == 10
    assert all(r.lang_pred != "und" for r in rows if r.doc_id in (3, 5, 8)) and langid.predict_languages(none, model).count() == 0
    assert langid.fit_languages(none) is None and langid.predict_languages(odd, None).where("lang_pred = 'und'").count() == 10


def test_many_languages(spark):
    letters = np.array([f"{a}{b}{c}" for a in "bcdfghjklmnpqrst" for b in "aeiou" for c in "bcdfghjklmnpqrstvwxyzaeio"])
    rng = np.random.default_rng(6)
    own = [letters[rng.permutation(len(letters))[:3]] for _ in range(2000)]
    rows = [(10 * i + k, f"l{i:04}", " ".join(rng.permutation(np.tile(w, 6)))) for i, w in enumerate(own) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    learned = docs.where(~in_fold("doc_id", 3, 1)).select("lang").distinct().count()
    model = langid.fit_languages(docs)
    assert len(model.languages) == learned > 1900
    few = docs.where("lang < 'l0040'").join(spark.createDataFrame([(x,) for x in model.languages], "lang string"), "lang").select("doc_id", "lang", "text")
    rows = langid.predict_languages(few, model).join(few, "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.9


def test_bounded_sample(spark):
    known = spark.createDataFrame([(i, "a" if i % 50 else "b", i % 7 != 0) for i in range(5000)] + [(9000, "long", False), (9001, None, True)], "k long, v string, fits boolean")
    found = collections.Counter(v for _, v in bounded_sample(known, 200))
    assert found == {"a": 100, "b": 85} and bounded_sample(known.limit(0), 10) == []


# 8


def removed(own, window):
    words = {i: re.findall(WORD, t or "") for i, t in own}
    seen = collections.Counter(tuple(w[j : j + window]) for i, _ in own for w in [words[i]] for j in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = {k for j in range(len(w) - window + 1) if seen[tuple(w[j : j + window])] > 1 for k in range(j, j + window)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("p", [substring.Passages(), substring.Passages(window=9, gram=4, batches=3)])
def test_passages(spark, p):
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(60)]
    made = [(50_000 + i, " ".join([*(f"u{i}_{j}" for j in range(int(rng.integers(0, 40)))), *passage[: int(rng.integers(20, 60))], *(f"t{i}_{j}" for j in range(9))])) for i in range(25)]
    made += [(60_000, " ".join(["again"] * 80)), (60_001, "\t".join(passage))]
    docs = table(spark, SMALL, "documents").select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    own = [(r.doc_id, r.text) for r in docs.collect()]
    rows = substring.remove_repeats(docs, p=p).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == removed(own, p.window)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in rows) and any(r.n_removed for r in rows)


def test_passages_odd_rows(odd, none):
    out = substring.remove_repeats(odd)
    assert out.columns == [c for c in odd.columns if c != "n_words"] + ["n_words", "n_removed", "kept_sha256", "kept_text"]
    rows = {r.doc_id: r for r in out.collect()}
    assert [rows[i].n_words for i in (1, 2, 6)] == [0, 0, 0] and rows[2].text is None and rows[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[5].n_words == 20_000 and out.count() == 10 and substring.remove_repeats(none).count() == 0
    twice = substring.remove_repeats(odd.where("doc_id = 5").union(odd.where("doc_id = 5"))).collect()
    assert [r.n_removed for r in twice] == [20_000, 20_000]


def test_fingerprint_index(spark):
    scratch, p = Scratch(spark, "test"), substring.Passages(window=6, gram=3, tier=2)
    make = lambda *ts: substring.find_anchors(spark.createDataFrame([(t,) for t in ts], "text string"), p=p)
    index = substring.FingerprintIndex(scratch, p=p)
    assert index.add(make("a b c d e f g h i")).count() == 0 and len(index.runs) == 1
    met = index.add(make("x a b c d e f g h i y", "k l m n o p q r"))
    assert met.count() > 0 and met.agg(F.max("n")).first()[0] == 2
    # two runs of level 0 have become one of level 1, which holds both batches
    assert [n.split("-")[1] for n in index.names] == ["1"]
    assert index.runs[0].agg(F.sum("n")).first()[0] == make("a b c d e f g h i", "x a b c d e f g h i y", "k l m n o p q r").count()
    assert index.add(make("z1 z2 z3 z4 z5 z6 z7")).count() == 0


def test_passages_of_a_second_call(spark, tmp_path):
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(50)]
    made = lambda k: [(k + i, " ".join([*(f"u{k + i}_{j}" for j in range(int(rng.integers(0, 30)))), *passage[int(rng.integers(0, 9)) : int(rng.integers(40, 50))], f"t{k + i}"])) for i in range(6)]
    first, second = made(0), made(100)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    p, path = substring.Passages(window=9, gram=4, tier=3), str(tmp_path / "index")
    substring.remove_repeats(frame(first), p=p, index=substring.FingerprintIndex(Scratch(spark, "test"), path, p)).count()
    again = substring.FingerprintIndex(Scratch(spark, "test"), path, p)  # opened anew
    assert len(again.names) == 2
    rows = substring.remove_repeats(frame(second), p=p, index=again, history=frame(first)).collect()
    want = removed(first + second, 9)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == {i: want[i] for i, _ in second} and any(r.n_removed for r in rows)


# 9


def test_weights():
    power, w = mixing.temperature_weights([1000, 100, 10], mixing.Mixing(repeat_limit=3.0))
    epochs = np.array(w) / np.array([1000, 100, 10])
    assert 0 < power < 1 and abs(epochs.max() / epochs.min() - 3.0) < 1e-6
    _, w = mixing.temperature_weights([1000, 100, 10], mixing.Mixing(repeat_limit=None, entropy=0.9))
    assert abs(-sum(x * math.log(x) for x in w) - 0.9) < 1e-6
    assert mixing.temperature_weights([5], mixing.Mixing())[1] == [1.0]


def test_mixture(spark):
    docs, m = table(spark, SMALL, "documents"), mixing.Mixing(block_words=2000)
    own = {r.doc_id: (r.source, len(re.findall(WORD, r.text))) for r in docs.collect()}
    rows = mixing.mixture(docs, m=m).collect()
    assert all((r.source, r.words) == own[r.doc_id] for r in rows) and len({(r.doc_id, r.epoch) for r in rows}) == len(rows)
    assert {r.doc_id for r in rows if r.epoch == 0} == set(own)
    total, mixed = collections.Counter(), collections.Counter()
    for s, n in own.values():
        total[s] += n
    for r in rows:
        mixed[r.source] += r.words
    sources = sorted(total)
    weights = dict(zip(sources, mixing.temperature_weights([total[s] for s in sources], m)[1], strict=True))
    budget = max(total[s] / weights[s] for s in sources)
    longest = max(n for _, n in own.values())
    assert all(weights[s] * budget - 2 * longest <= mixed[s] <= weights[s] * budget + 1 for s in sources)
    assert [r.asDict() for r in sorted(mixing.mixture(docs, m=m).collect())] == [r.asDict() for r in sorted(rows)]
    assert mixing.mixed_documents(docs, m=m).count() == len(rows)


def test_mixture_of_more_sources_than_are_listed(spark):
    docs = table(spark, SMALL, "documents")
    one, two = (sorted(map(str, mixing.mixture(docs, m=mixing.Mixing(block_words=2000, listed=n)).collect())) for n in (100, 1))
    assert one == two
    own = [r.n for r in mixing.mixture(docs).where("epoch = 0").groupBy("source").agg(F.sum("words").alias("n")).collect()]
    target = 0.5 * (math.log(len(own)) - sum(-x / sum(own) * math.log(x / sum(own)) for x in own)) + sum(-x / sum(own) * math.log(x / sum(own)) for x in own)
    m = mixing.Mixing(repeat_limit=None, entropy=target)
    mixed = collections.Counter()
    for r in mixing.mixture(docs, m=m).collect():
        mixed[r.source] += r.words
    weights = mixing.temperature_weights(sorted(own), m)[1]
    assert np.allclose(sorted(mixed.values()) / np.sum(list(mixed.values())), weights, atol=0.02)


def test_mixed_documents_pass_any_column(spark):
    own = spark.createDataFrame([(i, "a b c", "s" if i else "t", i, i, i, i, i) for i in range(9)] + [(None, "x", "s", 1, 1, 1, 1, 1)], "doc_id long, text string, source string, _nth int, _times int, _d int, _s int, row int")
    out = mixing.mixed_documents(own)
    assert out.columns == own.columns and {tuple(r) for r in out.collect()} == {tuple(r) for r in own.collect()}


def test_mixture_odd_rows(odd, none):
    rows = mixing.mixture(odd).collect()
    assert collections.Counter(r.doc_id for r in rows if r.epoch == 0) == {i: 1 for i in (1, 2, 3, None, 5, 6, 7, 8, 9)}
    assert next(r.words for r in rows if r.doc_id == 3) == 4 and mixing.mixture(none).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns and mixing.mixed_documents(odd).count() >= 10


def test_near_duplicates_shared_ids(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "end"])), (2, "something else that is not at all near the first one"), (3, " ".join(["x", *words]))], "doc_id long, text string")
    rows = minhash.near_duplicates(docs).collect()
    assert {r.component_id for r in rows if r.n_shingles > 30} == {1} and len(rows) == 4


def thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_collide_modulo_a_power_of_two(spark):
    a, b = thue_morse(10)
    docs = spark.createDataFrame([(1, f"p q {a} r s"), (2, f"p q {b} r s")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 2}
    side = [f"w{i}" for i in range(20)]
    own = [(i, " ".join([*side, x, *side])) for i, x in ((1, a), (2, b))]
    rows = substring.remove_repeats(spark.createDataFrame(own, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == removed(own, 35) and all(r.n_removed == 0 for r in rows)


@pytest.mark.parametrize("broken", [False, True])
def test_exact_sets(monkeypatch, broken):
    if broken:  # every word and window hashes alike: only the comparison of words is left
        monkeypatch.setattr(words, "word_hashes", lambda buf, a, b: np.zeros(len(a), np.uint64))
        monkeypatch.setattr(words, "window_hashes", lambda w, a, b: np.zeros(len(a), np.uint64))
    own = ["a b c d e f", "A b C d e f g", "", None, "x y", "X\tY", "a b c d e f a b c d e f", "one"]
    sets = words.exact_sets(pa.array(own), 5)
    want = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in own)]
    assert [len(s) for s in sets] == [len(s) for s in want]
    assert all(len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j]) for i in range(8) for j in range(8))


def test_checkpoint_folder_and_disposable_tables(spark, tmp_path):
    class Cluster:
        """A session without a checkpoint folder."""

        conf, sparkContext = {}, type("Context", (), {"master": "spark://host:7077", "getCheckpointDir": lambda self: None})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Cluster())
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with disposable():
        scratch = Scratch(spark, "test")
        kept = scratch.write(spark.range(3).toDF("id"), "kept")
        assert kept.count() == 3
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        spark.read.parquet(scratch.root)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == usual


def test_least_hashed(spark):
    df = spark.range(5000).selectExpr("id as k", "cast(id as string) as v").union(spark.range(4000).selectExpr("7L as k", "'7' as v"))
    found = least_hashed(df, ["k"], "v", 100)
    assert len(found) == len(set(found)) == 100 and found == least_hashed(df.repartition(5), ["k"], "v", 100)
    assert sorted(least_hashed(df.where("k < 30"), ["k"], "v", 100), key=int) == [str(i) for i in range(30)]
    assert least_hashed(df.where("k < 0"), ["k"], "v", 100) == []
