"""Packing of token pieces in fixed-length sequences by a configuration linear program over the length histogram.

The histogram (one count per length, so its size does not grow with the corpus) goes to the driver. Multiplicative
weights price the lengths, an unbounded knapsack program finds near-optimal fillings of a sequence under these
prices, their use is scaled and rounded down, and what is left is placed by best fit, also on the histogram. The result,
a bounded list of fillings and how often each is used, goes back to the tasks; a piece finds its sequence from its
length and its rank among pieces of that length.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, lean
from .words import text_slices

Filling = tuple[tuple[int, int], ...]  # (length, copies), longest first


@dataclass(frozen=True)
class Packing:
    capacity: int = 2048
    end_id: int = 0
    tokenizer: str = "word_bpe_49k.json"  # a name known to public_tokenizers, or a path
    cached_words: int = 400_000
    rounds: int = 24  # of pricing, in each pass
    # (eta, share): weights are exp(-eta * covered share * rounds / 8); fractions are rounded up for the fullest share of use (0: none, and once)
    roundings: tuple[tuple[float, float], ...] = ((0.3, 1.0), (3.0, 1.0), (0.3, 0.0))
    passes: int = 4  # the program is solved again for what rounding leaves
    rest: float = 0.02  # of the tokens: below this share best fit places what is left


def tokenizer_path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)")


_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordTokens:
    """Token ids of words as little-endian bytes, with a bounded memory of words seen.

    If the vocabulary is lower case, drops white space and never joins across it, the ids of a text are those of its
    words in turn; for any other tokenizer, whole texts are encoded. A word of ASCII or Latin-1 letters, then perhaps punctuation, is looked up as these two parts: the
    vocabulary cuts there too, and only letters not met before go to the merges.
    """

    def __init__(self, path: str, keep: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.keep, self.known = Tokenizer.from_file(path), keep, {}
        self.merges = self.tokenizer.model.tokenize
        self.packed = [i.to_bytes(4, "little") for i in range(1 + max(self.tokenizer.get_vocab().values(), default=0))]
        # the short way below holds for lower-casing vocabularies that drop white space; others read whole texts
        whole = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.by_words = whole("Ab  cd.\n") == whole("ab cd.") == [*whole("ab"), *whole("cd.")]
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}

    def of(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_words:
            return [np.array(self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        # a special token's string is case sensitive, so texts with its opening are left as they are
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        known, out = self.known, []
        for words in split:
            ids = list(map(known.get, words))
            if None in ids:
                self._learn({w for w, i in zip(words, ids, strict=True) if i is None})
                ids = [known[w] if i is None else i for w, i in zip(words, ids, strict=True)]
                if len(known) > self.keep:
                    known.clear()
            out.append(b"".join(ids))
        return out

    def _learn(self, words: set[bytes]) -> None:
        known, odd, merges, packed = self.known, [], self.merges, self.packed
        for w in words:
            base, tail = w.rstrip(_MARKS), b""
            # letters of ASCII alone need no look at the bytes one by one
            if base.isalpha() and base.islower():
                text = base.decode()
            else:
                m = _PLAIN.fullmatch(w)
                if not m:
                    odd.append(w)
                    continue
                base = m.group(1)
                text = base.decode().lower().translate(self.letters)
            tail = w[len(base) :]
            if b"<|" in tail:
                odd.append(w)
                continue
            ids = known.get(base)
            if ids is None:
                known[base] = ids = b"".join([packed[k.id] for k in merges(text)])
            if tail:
                if tail not in known:
                    known[tail] = self._whole([tail])[0]
                known[w] = ids + known[tail]
        for i in range(0, len(odd), 4096):
            known.update(zip(odd[i : i + 4096], self._whole(odd[i : i + 4096]), strict=True))

    def _whole(self, words: list[bytes]) -> list[bytes]:
        """By the tokenizer itself, with its own rules for cutting."""
        enc = self.tokenizer.encode([w.decode("utf-8", "replace") for w in words], is_pretokenized=True, add_special_tokens=False)
        raw = np.array(enc.ids, "<u4").tobytes()
        of = np.array([-1 if x is None else x for x in enc.word_ids], np.int64)
        starts, ends = (np.searchsorted(of, np.arange(len(words)), side).tolist() for side in ("left", "right"))
        return [raw[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]


_TOKENS: dict[tuple[str, int], WordTokens] = {}


def word_tokens(path: str, keep: int) -> WordTokens:
    """One per Python worker, so that words met by its earlier tasks are known to later ones."""
    if (path, keep) not in _TOKENS:
        _TOKENS[path, keep] = WordTokens(path, keep)
    return _TOKENS[path, keep]


def _cutter(p: Packing, path: str, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = word_tokens(path, p.cached_words), TaskContext.get().partitionId()
        end, seen = np.array([p.end_id], "<u4").tobytes(), np.zeros(p.capacity + 1, np.int64)
        for batch in batches:
            for first, buf, offs in text_slices(batch.column(1)):
                raw = buf.tobytes()
                row, piece, start, length, crc, nth, ids = [], [], [], [], [], [], []
                for i, data in enumerate(tokens.of([raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)])):
                    data += end
                    for k, at in enumerate(range(0, len(data) // 4, p.capacity)):
                        own = data[4 * at : 4 * (at + p.capacity)]
                        n = len(own) // 4
                        row.append(first + i)
                        piece.append(k)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(own))
                        nth.append(seen[n])
                        seen[n] += 1
                        if with_ids:
                            ids.append(own)
                columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(piece, pa.int32()), pa.array(np.full(len(row), part), pa.int32()), pa.array(nth, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, ["doc_id", "start", "length", "ids_crc32", "piece", "part", "nth", *["ids"] * with_ids])

    return cut


def _completions(price: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value within each capacity, and the length to take first there (0: none)."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        n = int(np.searchsorted(lengths, room, "right"))
        if n:
            value = best[room - lengths[:n]] + price[:n]
            i = int(value.argmax())
            best[room], take[room] = value[i], lengths[i]
        if best[room - 1] >= best[room]:
            best[room], take[room] = best[room - 1], take[room - 1] if best[room - 1] else 0
    return best, take


def _filling(first: int, take: np.ndarray, capacity: int) -> Filling:
    found, room = Counter({first: 1}), capacity - first
    while room and take[room]:
        found[int(take[room])] += 1
        room -= int(take[room])
    return tuple(sorted(found.items(), reverse=True))


def linear_program(histogram: dict[int, int], p: Packing, eta: float = 3.0) -> dict[Filling, float]:
    """Fractional use of fillings that covers no length more than once, by multiplicative weights.

    All lengths are to be covered at one pace. In each round a length's price is its tokens times a weight that falls
    exponentially with its covered share; the knapsack program completes a filling for every length behind the pace, and it
    is used until one of its lengths is ahead by a round.
    """
    lengths = np.array(sorted(histogram), np.int64)
    need = np.array([histogram[x] for x in lengths.tolist()], float)
    at = {x: i for i, x in enumerate(lengths.tolist())}
    covered, use = np.zeros(len(lengths)), Counter()
    for turn in range(1, p.rounds + 1):
        pace = turn / p.rounds
        lead = min(1.0, pace + 1 / p.rounds)
        price = lengths / p.capacity * np.exp(-eta * p.rounds / 8 * (covered - covered.min()))
        price[covered >= lead] = 0.0
        _, take = _completions(price, lengths, p.capacity)
        for i in np.flatnonzero(covered < pace)[::-1]:
            filling = _filling(int(lengths[i]), take, p.capacity)
            step = min((lead - covered[at[x]]) * need[at[x]] / n for x, n in filling)
            if step > 1e-9:
                use[filling] += step
                for x, n in filling:
                    covered[at[x]] += step * n / need[at[x]]
    return dict(use)


def best_fit(histogram: dict[int, int], capacity: int, begun: list[tuple[Filling, int]] = ()) -> list[tuple[Filling, int]]:
    """Longest first, each length in the fullest open sequences that hold it; whole groups of equal sequences move at once.

    begun: fillings that are there already, whose room is used too.
    """
    open_at: dict[int, list[tuple[Filling, int]]] = {}
    rooms: list[int] = []

    def put(room: int, filling: Filling, n: int) -> None:
        if room not in open_at:
            open_at[room] = []
            bisect.insort(rooms, room)
        open_at[room].append((filling, n))

    for filling, n in begun:
        put(capacity - sum(x * c for x, c in filling), filling, n)
    for x in sorted(histogram, reverse=True):
        left = histogram[x]
        while left:
            i = bisect.bisect_left(rooms, x)
            if i == len(rooms):
                each = capacity // x
                n, more = divmod(left, each)
                if n:
                    put(capacity - each * x, ((x, each),), n)
                if more:
                    put(capacity - more * x, ((x, more),), 1)
                break
            room = rooms[i]
            filling, n = open_at[room].pop()
            if not open_at[room]:
                del open_at[room], rooms[i]
            each = min(room // x, max(1, left // n))
            used = min(n, left // each)
            last, count = filling[-1]
            grown = (*filling[:-1], (x, count + each)) if last == x else (*filling, (x, each))
            if used < n:
                put(room, filling, n - used)
            put(room - each * x, grown, used)
            left -= used * each
    return [(f, n) for groups in open_at.values() for f, n in groups]


def _rounded(shares: dict[Filling, float], left: dict[int, int], share: float) -> list[tuple[Filling, int]]:
    """Whole uses of fillings: the integral parts first, then one more by the fractions; pieces used are taken from left.

    share: only the fullest fillings, of so much of all use, are used once more than their integral part. With 0, none is, and
    integral parts count only for pairs that fill a sequence exactly: no packing is worse for holding such a pair.
    """
    uses: Counter[Filling] = Counter()
    held = {f: sum(x * c for x, c in f) for f in shares}
    full = max(held.values(), default=0)
    total, least = 0.0, 0 if share else 1 << 62
    for f in sorted(shares, key=lambda f: -held[f]) if share else ():
        total += shares[f]
        least = held[f]
        if total >= share * sum(shares.values()):
            break
    most = sorted(shares.items(), key=lambda kv: (-kv[1], kv[0]))
    for wanted in (lambda f: int(shares[f] + 1e-6) if share or (held[f] == full and f[0][0] + f[-1][0] == full and len(f) == 2) else 0, lambda f: int(held[f] >= least)):
        for filling, _ in most:
            n = min(wanted(filling), *(left.get(k, 0) // c for k, c in filling))
            if n > 0:
                uses[filling] += n
                for k, c in filling:
                    left[k] -= n * c
        most.sort(key=lambda kv: (int(kv[1] + 1e-6) - kv[1], kv[0]))
    return list(uses.items())


def _plan(histogram: dict[int, int], p: Packing, eta: float, share: float) -> list[tuple[Filling, int]]:
    tokens, left, uses = sum(x * n for x, n in histogram.items()), dict(histogram), Counter()
    for _ in range(p.passes if share else 1):
        left = {k: n for k, n in left.items() if n}
        if sum(k * n for k, n in left.items()) <= max(p.rest * tokens, p.capacity):
            break
        for filling, n in _rounded(linear_program(left, p, eta), left, share):
            uses[filling] += n
    return best_fit({k: n for k, n in left.items() if n}, p.capacity, list(uses.items()))


def solve(histogram: dict[int, int], p: Packing = Packing()) -> list[tuple[Filling, int]]:
    """Fillings and how often each is used; together they hold the histogram exactly.

    The linear program is solved and rounded, then again for what is left, p.passes times or until little is; that is
    placed by best fit, in the room of the program's fillings too. Of the roundings, the one with the fewest sequences counts;
    none is tried after one that meets the bound of all tokens.
    """
    least, found = -(-sum(x * n for x, n in histogram.items()) // p.capacity), None
    for eta, share in p.roundings if histogram else ():
        plan = _plan(histogram, p, eta, share)
        if found is None or sum(n for _, n in plan) < sum(n for _, n in found):
            found = plan
        if sum(n for _, n in found) <= least:
            break
    return found or []


def _placer(plan: list[tuple[Filling, int]]):
    """Arrays sorted by (length, first rank): copies of one length in all sequences of one filling."""
    rows, base, rank = [], 0, Counter()
    for filling, n in plan:
        offset = 0
        for x, copies in filling:
            rows.append((x, rank[x], n, base, offset))
            rank[x] += n * copies
            offset += x * copies
        base += n
    table = np.array(sorted(rows) or np.zeros((0, 5)), np.int64).reshape(-1, 5)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            copy, nth = np.divmod(rank - row[:, 1], np.maximum(row[:, 2], 1))
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(row[:, 3] + nth), pa.array(row[:, 4] + copy * length)], [*kept, "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Packing = Packing(), with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids (little-endian, binary) on demand.

    A document is its token ids, then p.end_id. Documents longer than p.capacity are cut in pieces of p.capacity, the
    last may be shorter; no other document is cut. Sequences hold p.capacity tokens at most, without gaps.

    Nulls: a null or empty text gives one piece, the end id; a null doc_id stays null. Repeated rows are separate
    documents with equal pieces. A text of any length is handled whole. An empty table gives an empty result. Other
    columns, whatever their names, are not read.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, piece int, part int, nth long" + ", ids binary" * with_ids
    pieces = scratch.write(rows.mapInArrow(lean(_cutter(p, tokenizer_path(p.tokenizer), with_ids)), schema), "pieces")
    # ranks of equal lengths: those of earlier partitions come first; a row for each length and partition
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # p.capacity rows at most
    plan = solve(histogram, p)
    ranked = pieces.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(_placer(plan), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pack(..., with_ids=True): the pieces of each sequence in order; a group has p.capacity tokens at most."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.aggregate(ordered, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
