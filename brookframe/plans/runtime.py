"""What surrounds a query: hooks, lints, budgets, a result cache, guards for raw SQL."""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row

from .select import Select


class LintError(ValueError):
    pass


class BudgetError(RuntimeError):
    pass


def lint(query: Select) -> list[str]:
    """Warnings about a select: all columns, no limit."""
    out = [] if query.columns else ["selects all columns"]
    return out if query.most is not None or query.keys else [*out, "has no limit"]


def lint_change(kind: str, where: Any) -> None:
    """An update or delete without a condition is an error."""
    if kind in ("update", "delete") and where is None:
        raise LintError(f"{kind} without where")


def lint_raw(sql: str) -> list[str]:
    """The same by patterns for raw SQL."""
    plain = re.sub(r"'(?:[^']|'')*'", "''", sql)
    if re.match(r"\s*(delete|update)\b", plain, re.I) and not re.search(r"\bwhere\b", plain, re.I):
        raise LintError("change without where")
    out = ["selects all columns"] if re.search(r"\bselect\s+\*", plain, re.I) else []
    return out if re.search(r"\blimit\b", plain, re.I) or not re.match(r"\s*select\b", plain, re.I) else [*out, "has no limit"]


@dataclass
class Hooks:
    """before_compile: Select -> Select, in turn; before_execute: (DataFrame, notes) -> DataFrame; on_row sees rows that are streamed."""

    before_compile: list[Callable[[Select], Select]] = field(default_factory=list)
    before_execute: list[Callable[[DataFrame, dict], DataFrame]] = field(default_factory=list)
    on_row: list[Callable[[Row], None]] = field(default_factory=list)
    after_execute: list[Callable[[dict], None]] = field(default_factory=list)


class Cache:
    """Keeps up to `size` results persisted, for queries that ask for it by the note `cache`; the least recently used goes."""

    def __init__(self, size: int = 1000):
        self.size, self._kept = size, OrderedDict()

    def __call__(self, df: DataFrame, notes: dict) -> DataFrame:
        if not notes.get("cache"):
            return df
        key = notes["cache"] if isinstance(notes["cache"], str) else str(df.semanticHash())
        if key in self._kept:
            self._kept.move_to_end(key)
            return self._kept[key]
        self._kept[key] = df.persist()
        if len(self._kept) > self.size:
            self._kept.popitem(last=False)[1].unpersist()
        return self._kept[key]


@dataclass
class Runtime:
    """Builds and runs queries through the hooks. max_rows: a budget for rows that reach the client; None for none."""

    hooks: Hooks = field(default_factory=Hooks)
    max_rows: int | None = None

    def frame(self, query: Select) -> DataFrame:
        for hook in self.hooks.before_compile:
            query = hook(query)
        df = query.build()
        for hook in self.hooks.before_execute:
            df = hook(df, query.notes)
        return df

    def rows(self, query: Select) -> Iterator[Row]:
        n = 0
        df = self.frame(query)
        for row in (df.limit(self.max_rows + 1) if self.max_rows is not None else df).toLocalIterator():
            n += 1
            if self.max_rows is not None and n > self.max_rows:
                raise BudgetError(f"more than {self.max_rows} rows")
            for hook in self.hooks.on_row:
                hook(row)
            yield row
        for hook in self.hooks.after_execute:
            hook({"rows": n, "fingerprint": df.semanticHash()})


def prepared(spark, sql: str) -> Callable[..., DataFrame]:
    """A statement with named markers (:name), bound at each call."""
    lint_raw(sql)
    return lambda **values: spark.sql(sql, args=values)
