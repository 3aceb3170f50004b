"""Full-text operators over tokens: runs of letters and digits, in lower case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """The array of tokens, in order, with repeats: letters and digits of any script; anything else parts tokens."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _words(query: str | list[str]) -> list[str]:
    import re

    return re.findall(r"[^\W_]+", query.lower()) if isinstance(query, str) else [w.lower() for w in query]


def match_any(text: Column, query: str | list[str]) -> Column:
    return F.arrays_overlap(tokens(text), F.array(*map(F.lit, _words(query))))


match = match_any


def match_all(text: Column, query: str | list[str]) -> Column:
    return F.array_size(F.array_except(F.array(*map(F.lit, _words(query))), tokens(text))) == 0


def term(text: Column, token: str) -> Column:
    return F.array_contains(tokens(text), token)


def phrase(text: Column, words: str, slop: int = 0) -> Column:
    """The words in this order, with at most `slop` tokens between each two neighbours."""
    gap = "" if not slop else f"(?:[^ ]+ ){{0,{slop}}}"
    pattern = "^(?:.* )?" + gap.join(w + " " for w in _words(words))
    return F.concat(F.array_join(tokens(text), " "), F.lit(" ")).rlike(pattern)


def fuzzy(text: Column, word: str, distance: int = 1) -> Column:
    """Whether a token is at most `distance` (0 to 2) edits from the word."""
    if distance not in (0, 1, 2):
        raise ValueError("distance is 0, 1 or 2")
    return F.exists(tokens(text), lambda t: F.levenshtein(t, F.lit(word.lower())) <= distance)


def proximity(text: Column, first: str, distance: int, second: str, ordered: bool = False) -> Column:
    """Whether at most `distance` tokens stand between the two; ordered: the first one first."""
    found = phrase(text, f"{first} {second}", distance)
    return found if ordered else found | phrase(text, f"{second} {first}", distance)


def boost(score: Column, factor: float) -> Column:
    if not -2048 <= factor <= 2048:
        raise ValueError("the factor is from -2048 to 2048")
    return score * factor


def constant(matches: Column, score: float) -> Column:
    return F.when(matches, F.lit(score)).otherwise(F.lit(0.0))


def bm25(df: DataFrame, id_col: str, text_col: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the rows with any query word. Only counts of query words leave the rows; two small sums give the statistics."""
    words = sorted(set(_words(query)))
    if not words:
        return df.select(F.col(id_col), F.lit(0.0).alias("score")).limit(0)
    plain = df.select(F.col(id_col), tokens(F.col(text_col)).alias("_t"))
    short = plain.select(id_col, F.array_size("_t").alias("_n"), F.filter("_t", lambda t: t.isin(*words)).alias("_t"))
    # narrow rows behind one exchange, which the statistics and the scores share: texts are read once
    times = [F.array_size(F.filter("_t", F.lit(w).eqNullSafe)).alias(f"_{i}") for i, w in enumerate(words)]
    row = short.select(id_col, "_n", *times).repartition(F.col(id_col))
    totals = row.agg(F.count(F.lit(1)).alias("docs"), F.avg("_n").alias("mean"), *[F.count(F.when(F.col(f"_{i}") > 0, 1)).alias(f"d{i}") for i in range(len(words))])
    joined = row.where(F.greatest(*[F.col(f"_{i}") for i in range(len(words))], F.lit(0)) > 0).crossJoin(F.broadcast(totals))  # one row
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.log1p((F.col("docs") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        tf = F.col(f"_{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_n") / F.col("mean")))
    return joined.select(id_col, score.alias("score"))
