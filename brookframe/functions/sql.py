"""Expressions of the relational lanes: three-valued logic, as in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


class Functions:
    """The functions that callbacks get as their second argument. Registered operations are further methods."""

    def __init__(self, operations: dict[str, Callable[..., Column]] | None = None):
        self._operations = operations or {}

    def __getattr__(self, name: str) -> Callable[..., Column]:
        try:
            return self._operations[name]
        except KeyError:
            raise AttributeError(f"no function {name}") from None

    def eq(self, a: Any, b: Any) -> Column:
        """Comparison with None is IS NULL."""
        if a is None or b is None:
            return _col(b if a is None else a).isNull()
        return _col(a) == b

    def ne(self, a: Any, b: Any) -> Column:
        if a is None or b is None:
            return _col(b if a is None else a).isNotNull()
        return _col(a) != b

    def gt(self, a: Any, b: Any) -> Column:
        return _col(a) > b

    def gte(self, a: Any, b: Any) -> Column:
        return _col(a) >= b

    def lt(self, a: Any, b: Any) -> Column:
        return _col(a) < b

    def lte(self, a: Any, b: Any) -> Column:
        return _col(a) <= b

    def and_(self, *parts: Any) -> Column:
        """Of nothing: true."""
        return reduce(lambda a, b: a & b, map(_col, parts), F.lit(True)) if parts else F.lit(True)

    def or_(self, *parts: Any) -> Column:
        """Of nothing: false."""
        return reduce(lambda a, b: a | b, map(_col, parts[1:]), _col(parts[0])) if parts else F.lit(False)

    def not_(self, a: Any) -> Column:
        return ~_col(a)

    def all(self) -> Column:
        return F.lit(True)

    def in_(self, a: Any, values: Any) -> Column:
        """Of a list, or of a one-column query; an empty list holds nothing."""
        if isinstance(values, list | tuple | set):
            return _col(a).isin(*values) if values else F.lit(False)
        return _col(a).isin(_frame(values))

    def not_in(self, a: Any, values: Any) -> Column:
        """As SQL has it: a null among the values makes no row match. Of a query: true or false, never null.

        A query becomes an anti join on equal values and two one-row checks, so it need not fit in every task.
        """
        if isinstance(values, list | tuple | set):
            return ~self.in_(a, values)
        rows = _frame(values).toDF("_listed")
        none = rows.where(F.col("_listed") == _col(a).outer()).exists()
        return ~none & ~rows.where("_listed is null").exists() & (_col(a).isNotNull() | ~rows.exists())

    def exists(self, query: Any) -> Column:
        return _frame(query).exists()

    def not_exists(self, query: Any) -> Column:
        return ~_frame(query).exists()

    def scalar(self, query: Any) -> Column:
        return _frame(query).scalar()

    def like(self, a: Any, pattern: str) -> Column:
        return _col(a).like(pattern)

    def ilike(self, a: Any, pattern: str) -> Column:
        return _col(a).ilike(pattern)

    def contains(self, a: Any, part: Any) -> Column:
        return _col(a).contains(part)

    def starts_with(self, a: Any, part: Any) -> Column:
        return _col(a).startswith(part)

    def ends_with(self, a: Any, part: Any) -> Column:
        return _col(a).endswith(part)

    def is_null(self, a: Any) -> Column:
        return _col(a).isNull()

    def is_not_null(self, a: Any) -> Column:
        return _col(a).isNotNull()

    def raw(self, sql: str, returns: str | None = None) -> Column:
        found = F.expr(sql)
        return found.cast(returns) if returns else found

    def case(self, *branches: tuple[Any, Any], else_: Any = None) -> Column:
        """Searched CASE; without else_, null."""
        if not branches:
            raise ValueError("CASE needs a branch")
        out = F.when(_col(branches[0][0]), branches[0][1])
        for when, then in branches[1:]:
            out = out.when(_col(when), then)
        return out if else_ is None else out.otherwise(else_)

    def cast(self, a: Any, kind: str) -> Column:
        return _col(a).cast(kind)

    def call(self, name: str, *args: Any) -> Column:
        return F.call_function(name, *map(_col, args))

    def json_object(self, **fields: Any) -> Column:
        return F.struct(*[_col(v).alias(k) for k, v in fields.items()])

    def json_array_agg(self, value: Any, *order: Any) -> Column:
        """An array of the group's values, sorted by order (then value); empty for no rows. Nulls stay."""
        ranked = F.array_sort(F.collect_list(F.struct(*[_col(o).alias(f"o{i}") for i, o in enumerate(order)], _col(value).alias("v"))))
        return F.transform(ranked, lambda x: x["v"])

    def row_number(self, partition_by: list = (), order_by: list = ()) -> Column:
        from pyspark.sql import Window

        return F.row_number().over(Window.partitionBy(*partition_by).orderBy(*(order_by or [F.lit(1)])))

    def count(self, a: Any = None) -> Column:
        """Rows, or values that are not null."""
        return F.count(F.lit(1)) if a is None else F.count(_col(a))

    def sum(self, a: Any) -> Column:
        return F.sum(_col(a))

    def avg(self, a: Any) -> Column:
        return F.avg(_col(a))

    def min(self, a: Any) -> Column:
        return F.min(_col(a))

    def max(self, a: Any) -> Column:
        return F.max(_col(a))


def _frame(query: Any) -> DataFrame:
    return query if isinstance(query, DataFrame) else query.build()
