"""The relational builder: an immutable list of clauses that becomes one DataFrame.

Tables take part under an alias; inside, a column is named `alias.column`, so that no two can be confused. Sorting follows
SQL servers: nulls last ascending, first descending, unless asked otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sql import Functions


class Fields:
    """Columns by name: f.alias.column, or f.column where only one table has it (or a select alias has that name)."""

    def __init__(self, tables: dict[str, list[str]], outer: bool = False, extra: dict[str, Column] | None = None):
        self._tables, self._outer, self._extra = tables, outer, extra or {}

    def _column(self, alias: str, name: str) -> Column:
        c = F.col(f"`{alias}.{name}`")
        return c.outer() if self._outer else c

    def __getattr__(self, name: str) -> Any:
        return self[name]

    def __getitem__(self, name: str) -> Any:
        if name in self._tables:
            return _TableFields(self, name)
        if name in self._extra:
            return self._extra[name]
        owners = [a for a, columns in self._tables.items() if name in columns]
        if len(owners) != 1:
            raise AttributeError(f"{'ambiguous' if owners else 'unknown'} column {name}")
        return self._column(owners[0], name)


class _TableFields:
    def __init__(self, fields: Fields, alias: str):
        self._fields, self._alias = fields, alias

    def __getattr__(self, name: str) -> Column:
        return self[name]

    def __getitem__(self, name: str) -> Column:
        if name not in self._fields._tables[self._alias]:
            raise AttributeError(f"unknown column {self._alias}.{name}")
        return self._fields._column(self._alias, name)


@dataclass(frozen=True)
class Order:
    column: Any
    direction: str = "asc"
    nulls: str | None = None

    def reverse(self) -> Order:
        nulls = {None: None, "first": "last", "last": "first"}[self.nulls]
        return Order(self.column, "desc" if self.direction == "asc" else "asc", nulls)

    def on(self, column: Column) -> Column:
        nulls = self.nulls or ("last" if self.direction == "asc" else "first")
        return getattr(column, f"{self.direction}_nulls_{nulls}")()


def _named(df: DataFrame, alias: str, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{alias}.{c}") for c in columns])


@dataclass(frozen=True)
class Select:
    """A query over one or more tables. Every method returns a new query; build() gives the DataFrame."""

    source: DataFrame
    tables: dict[str, list[str]]
    functions: Functions = field(default_factory=Functions)
    columns: tuple[tuple[str, Any], ...] = ()
    filters: tuple[Column, ...] = ()
    keys: tuple[Any, ...] = ()
    filter_groups: Any = None
    orders: tuple[Order, ...] = ()
    first_on: tuple[Any, ...] = ()
    unique: bool = False
    most: int | None = None
    skip: int = 0
    notes: dict[str, Any] = field(default_factory=dict)
    outer: Fields | None = None

    @staticmethod
    def table(df: DataFrame, alias: str, functions: Functions | None = None) -> Select:
        return Select(_named(df, alias, df.columns), {alias: df.columns}, functions or Functions())

    @staticmethod
    def nothing(spark, functions: Functions | None = None) -> Select:
        """One row without columns: SELECT without FROM."""
        return Select(spark.range(1).select(), {}, functions or Functions())

    def as_(self, alias: str) -> Select:
        """A table under another alias, or a query as a derived table."""
        plain = len(self.tables) == 1 and not (self.columns or self.filters or self.keys or self.orders or self.unique or self.first_on or self.most is not None or self.skip)
        if plain:
            old = next(iter(self.tables))
            return Select.table(self.source.select(*[F.col(f"`{old}.{c}`").alias(c) for c in self.tables[old]]), alias, self.functions)
        return Select.table(self.build(), alias, self.functions)

    @property
    def f(self) -> Fields:
        return Fields(self.tables)

    def _value(self, x: Any, extra: dict[str, Column] | None = None) -> Column:
        f = Fields(self.tables, extra=extra)
        if isinstance(x, Column):
            return x
        if isinstance(x, str):
            return f[x]
        found = x(f, self.functions) if x.__code__.co_argcount > 1 else x(f)
        return found if isinstance(found, Column) else F.lit(found)

    # joins
    def _join(self, other: Select, on: Any, how: str) -> Select:
        clash = self.tables.keys() & other.tables.keys()
        if clash:
            raise ValueError(f"alias {clash.pop()} is used twice")
        if other.columns or other.filters or other.keys:
            raise ValueError("give a query an alias before it is joined")
        both = replace(self, tables=self.tables | other.tables)
        on = F.lit(True) if on is True else both._value(on)
        return replace(both, source=self._filtered().join(other.source, on, how), filters=())

    def inner_join(self, other: Select, on: Any) -> Select:
        return self._join(other, on, "inner")

    def outer_left_join(self, other: Select, on: Any) -> Select:
        return self._join(other, on, "left")

    def outer_right_join(self, other: Select, on: Any) -> Select:
        return self._join(other, on, "right")

    def outer_full_join(self, other: Select, on: Any) -> Select:
        return self._join(other, on, "full")

    def _lateral(self, alias: str, build: Callable[[Fields], Select], how: str) -> Select:
        inner = build(Fields(self.tables, outer=True))
        # its outer columns are resolved by the join, so its schema must not be asked for before
        names = [name for name, _ in inner._output()]
        return replace(self, source=self._filtered().lateralJoin(_named(inner.build(), alias, names), how=how), filters=(), tables=self.tables | {alias: names})

    def lateral_join(self, alias: str, build: Callable[[Fields], Select]) -> Select:
        """build gets the columns so far and returns a query that may use them."""
        return self._lateral(alias, build, "inner")

    def outer_lateral_join(self, alias: str, build: Callable[[Fields], Select]) -> Select:
        return self._lateral(alias, build, "left")

    # clauses
    def select(self, *what: Any, **named: Any) -> Select:
        """Names, ('alias', expression), a function of (f, fns) that returns a dict, or alias=expression. Calls accumulate."""
        found: list[tuple[str, Any]] = []
        if len(what) == 2 and isinstance(what[0], str) and not isinstance(what[1], str):
            found.append((what[0], what[1]))
        else:
            for w in what:
                if isinstance(w, str):
                    self.f[w]  # raises if unknown
                    found.append((w, w))
                else:
                    found += list(w(self.f, self.functions).items())
        return replace(self, columns=(*self.columns, *found, *named.items()))

    def where(self, predicate: Any) -> Select:
        return replace(self, filters=(*self.filters, self._value(predicate)))

    def group_by(self, *keys: Any) -> Select:
        return replace(self, keys=(*self.keys, *keys))

    def having(self, predicate: Any) -> Select:
        """The last call counts."""
        return replace(self, filter_groups=predicate)

    def order_by(self, column: Any, direction: str = "asc", nulls: str | None = None) -> Select:
        return replace(self, orders=(*self.orders, Order(column, direction, nulls)))

    def limit(self, n: int) -> Select:
        return replace(self, most=n)

    def offset(self, n: int) -> Select:
        return replace(self, skip=n)

    def distinct(self) -> Select:
        return replace(self, unique=True)

    def distinct_on(self, *columns: Any) -> Select:
        """The first row by order_by of each value of the columns."""
        return replace(self, first_on=columns)

    def annotate(self, name: str, value: Any) -> Select:
        return replace(self, notes=self.notes | {name: value})

    def _filtered(self) -> DataFrame:
        df = self.source
        for c in self.filters:
            df = df.where(c)
        return df

    def _output(self) -> tuple[tuple[str, Any], ...]:
        """What is selected; without select, all columns, named with their alias where tables share a name."""
        if self.columns:
            return self.columns
        names = [c for cs in self.tables.values() for c in cs]
        return tuple((c if names.count(c) == 1 else f"{a}_{c}", F.col(f"`{a}.{c}`")) for a, cs in self.tables.items() for c in cs)

    def build(self) -> DataFrame:
        df = self._filtered()
        chosen = {name: self._value(x) for name, x in self._output()}
        hidden: list[tuple[str, Column]] = []

        def hide(x: Any) -> Column:
            """Order by and having may use select aliases, source columns and aggregates alike."""
            if isinstance(x, str) and x in chosen:
                return F.col(f"`{x}`")
            hidden.append((f"_{len(hidden)}", self._value(x, chosen)))
            return F.col(hidden[-1][0])

        order = [o.on(hide(o.column)) for o in self.orders]
        on = [hide(c) for c in self.first_on]
        kept = hide(self.filter_groups) if self.filter_groups is not None else None
        out = [c.alias(n) for n, c in (*chosen.items(), *hidden)]
        if self.keys:
            keys = [chosen[k] if isinstance(k, str) and k in chosen else self._value(k) for k in self.keys]
            df = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*out)
        else:
            df = df.select(*out)
        if kept is not None:
            df = df.where(kept)
        if on:
            rank = F.row_number().over(Window.partitionBy(*on).orderBy(*(order or on)))
            df = df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
        if self.unique:
            if hidden:
                raise ValueError("with distinct, order by selected columns")
            df = df.distinct()
        if order:
            df = df.orderBy(*order)
        if self.skip:
            df = df.offset(self.skip)
        if self.most is not None:
            df = df.limit(self.most)
        return df.select(*[F.col(f"`{n}`") for n in chosen])

