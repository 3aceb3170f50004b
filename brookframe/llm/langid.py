"""Language identification as a mixture: each document's language shares by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import bounded_sample, in_fold
from .scratch import lean
from .words import LOWER, text_slices


@dataclass(frozen=True)
class LangId:
    """fit_rows labelled documents of at most fit_chars characters fit the n-gram tables, as many of each language, and one at least.

    Any number of languages can be learned: the tables hold only n-grams that the sample has.
    """

    fit_rows: int = 2000
    fit_chars: int = 20_000
    folds: int = 3
    held_out: int = 1
    gram: int = 4  # bytes
    buckets: int = 1 << 15
    smoothing: float = 0.02
    steps: int = 12
    penalty: float = 4.0  # times the logarithm of the number of n-grams, for each language in the set


_LETTERS = np.where((np.arange(256) >= 128) | ((LOWER >= 97) & (LOWER <= 122)), LOWER, 32).astype(np.uint8)


def gram_ids(buf: np.ndarray, offs: np.ndarray, p: LangId) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of letters (anything else is a space; runs of only spaces are left out), and each text's first."""
    n = len(buf) - p.gram + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    plain = _LETTERS[buf].astype(np.uint32)
    code = np.zeros(n, np.uint32)
    for i in range(p.gram):
        code = code << np.uint32(8) | plain[i : i + n]
    start = np.searchsorted(offs, np.arange(n), "right") - 1
    whole = (np.arange(n) + p.gram <= offs[start + 1]) & (code != np.uint32(0x20202020))
    at = np.flatnonzero(whole)
    ids = (code[at] * np.uint32(2654435761)) >> np.uint32(32 - int(p.buckets).bit_length() + 1)
    return ids.astype(np.int64), np.searchsorted(at, offs)


def has_letter(raw: bytes) -> bool:
    low = raw.lower()
    return low.upper() != low or any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def _fit(log: np.ndarray, count: np.ndarray, chosen: list[int], steps: int) -> tuple[float, np.ndarray]:
    """(log likelihood, shares) of a mixture of the chosen languages; log has a row per n-gram, scaled by its greatest."""
    like = np.exp(log[:, chosen])
    share, n = np.full(len(chosen), 1 / len(chosen)), count.sum()
    for _ in range(steps if len(chosen) > 1 else 0):
        parts = like * share
        share = (count / np.maximum(parts.sum(axis=1), 1e-300)) @ parts / n
    return float(count @ np.log(np.maximum(like @ share, 1e-300))), share


@dataclass
class Model:
    """Log probabilities of n-gram buckets under each language, as a list of (language, excess over `base`) for each bucket."""

    p: LangId
    languages: list[str]
    first: np.ndarray  # of each bucket, and the end of all
    language: np.ndarray
    excess: np.ndarray
    base: np.ndarray  # of a bucket that a language does not have

    def logs(self, seen: np.ndarray) -> np.ndarray:
        """A row of log probabilities for each bucket."""
        n = self.first[seen + 1] - self.first[seen]
        at = np.arange(n.sum()) + np.repeat(self.first[seen] - np.cumsum(n) + n, n)
        out = np.tile(self.base, (len(seen), 1))
        out[np.repeat(np.arange(len(seen)), n), self.language[at]] += self.excess[at]
        return out

    def mixture(self, ids: np.ndarray) -> list[tuple[str, float]]:
        """The document's languages and their shares, greatest first: the set with the best penalised likelihood.

        Sets are grown from the likeliest single language by the shares that the mixture of all gives; a larger set must
        gain more than the penalty.
        """
        count = np.bincount(ids, minlength=self.p.buckets)
        seen = np.flatnonzero(count)
        count = count[seen].astype(float)
        log = self.logs(seen)
        log = log - log.max(axis=1, keepdims=True)
        price = self.p.penalty * np.log(max(2.0, count.sum()))
        single = count @ log
        order = [int(single.argmax())]
        if len(self.languages) > 1:
            share = _fit(log, count, list(range(len(self.languages))), self.p.steps)[1]
            order += [int(i) for i in np.argsort(-share, kind="stable") if i != order[0]]
        best, found = float(single[order[0]]) - price, np.ones(1)
        for k in range(2, len(order) + 1):
            value, share = _fit(log, count, order[:k], self.p.steps)
            if value - k * price <= best:
                break
            best, found = value - k * price, share
        pairs = [(self.languages[order[i]], float(x)) for i, x in enumerate(found)]
        return sorted(pairs, key=lambda x: (-x[1], x[0]))


def fit_languages(docs: DataFrame, p: LangId = LangId(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """n-gram tables from rows with a language outside the held-out fold; None if there are none."""
    own = docs.where(~in_fold(id_col, p.folds, p.held_out) & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{lang_col}`").cast("string").alias("_lang"), F.length(F.col(f"`{text_col}`").cast("string")).alias("_n"))
    known = own.groupBy("_id").agg(F.min("_lang").alias("_lang"), (F.min("_n") <= p.fit_chars).alias("fits"))
    picked = bounded_sample(known, p.fit_rows)
    if not picked:
        return None
    ids = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in sorted({i for i, _ in picked})], "_id long"))  # fit_rows ids, or one for each language
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{lang_col}`").cast("string").alias("_lang"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    rows = rows.where((F.length("_text") <= p.fit_chars) & F.col("_lang").isNotNull()).join(ids, "_id").select("_lang", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, total = np.array(batch.column(0).to_pylist(), object), {}
            for at, buf, offs in text_slices(batch.column(1)):
                grams, first = gram_ids(buf, offs, p)
                for i, name in enumerate(names[at : at + len(offs) - 1]):
                    total[name] = total.get(name, 0) + np.bincount(grams[first[i] : first[i + 1]], minlength=p.buckets)
            for name, n in total.items():
                seen = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen), pa.array(n[seen].astype(np.int64))], ["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # n-grams of the bounded sample
    names = counts.column("lang").to_pylist()
    languages = sorted(set(names))
    if not languages:
        return None
    number = {x: i for i, x in enumerate(languages)}
    language, bucket, n = np.array([number[x] for x in names]), counts.column("bucket").to_numpy(), counts.column("n").to_numpy().astype(float)
    total = np.bincount(language, n, len(languages)) + p.smoothing * p.buckets
    order = np.lexsort((language, bucket))
    language, bucket, n = language[order], bucket[order], n[order]
    return Model(p, languages, np.searchsorted(bucket, np.arange(p.buckets + 1)), language, np.log1p(n / p.smoothing), np.log(p.smoothing / total))


def predict_languages(docs: DataFrame, model: Model | None, p: LangId = LangId(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, languages.

    languages are the document's set and shares, lang_pred the greatest share, score that share. A text that is null or has
    no letter, and every text if there is no model, is `und` with score 0 and an empty set; a text with letters but no
    n-gram (shorter than one) is matched as if padded with spaces. A null doc_id is not held out. Repeated rows get equal
    answers, ties go to the language first by name. Texts of any length are read whole. An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), in_fold(id_col, p.folds, p.held_out).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, buf, offs in text_slices(batch.column(2)):
                ids, first = gram_ids(buf, offs, p)
                raw = buf.tobytes()
                for a, b, i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    if model is None or not has_letter(raw[a:b]):
                        found.append([])
                        continue
                    own = ids[i:j]
                    if not len(own):
                        padded = np.frombuffer((raw[a:b] + b"    ").rjust(8), np.uint8)
                        own = gram_ids(padded, np.array([0, len(padded)]), p)[0]
                    found.append(model.mixture(own))
            sets = pa.array([[{"lang": x, "share": y} for x, y in f] for f in found], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0][0] if f else "und" for f in found], pa.string()), pa.array([min(1.0, f[0][1]) if f else 0.0 for f in found], pa.float64()), sets], ["doc_id", "held_out", "lang_pred", "score", "languages"])

    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double, languages array<struct<lang: string, share: double>>")
