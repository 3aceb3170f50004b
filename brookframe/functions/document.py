"""Expressions and accumulators of the document pipeline: two-valued comparisons, null and missing are one."""

from __future__ import annotations

import datetime
import decimal
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def value(x: Any) -> Column:
    """'$a.b' is a field, a Column itself, anything else a literal; lists and dicts of these are arrays and structs."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str) and x.startswith("$"):
        return F.col(x[1:])
    if isinstance(x, list | tuple):
        return F.array(*map(value, x))
    if isinstance(x, dict):
        return F.struct(*[value(v).alias(k) for k, v in x.items()])
    return F.lit(x)


def _compare(a: Any, b: Any) -> Column:
    """-1, 0 or 1; null is below everything."""
    a, b = value(a), value(b)
    return F.when(a.eqNullSafe(b), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).otherwise(1)


#: Date format marks and their patterns.
DATE_MARKS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%L": "SSS", "%j": "DDD", "%z": "xx", "%%": "%"}


def date_pattern(marks: str) -> str:
    parts = re.split(r"(%[A-Za-z%])", marks)
    return "".join(DATE_MARKS[p] if p in DATE_MARKS else "'" + p.replace("'", "''") + "'" if re.search("[A-Za-z']", p) else p for p in parts)


#: Type names of documents.
TYPE_NAMES = {"string": "string", "double": "double", "int": "int", "bigint": "long", "boolean": "bool", "timestamp": "date", "date": "date", "timestamp_ntz": "date", "binary": "binData", "float": "double"}


class _Expressions:
    # arithmetic
    def add(self, *xs: Any) -> Column:
        out = value(xs[0])
        for x in xs[1:]:
            out = out + value(x)
        return out

    def subtract(self, a: Any, b: Any) -> Column:
        return value(a) - value(b)

    def multiply(self, *xs: Any) -> Column:
        out = value(xs[0])
        for x in xs[1:]:
            out = out * value(x)
        return out

    def divide(self, a: Any, b: Any) -> Column:
        """Null for a zero divisor."""
        return F.try_divide(value(a).cast("double"), value(b).cast("double"))

    # strings
    def concat(self, *xs: Any) -> Column:
        return F.concat(*map(value, xs))

    def to_lower(self, x: Any) -> Column:
        return F.coalesce(F.lower(value(x)), F.lit(""))

    def to_upper(self, x: Any) -> Column:
        return F.coalesce(F.upper(value(x)), F.lit(""))

    def substr(self, x: Any, start: int, n: int) -> Column:
        return F.substring(value(x), start + 1, n)

    def substr_bytes(self, x: Any, start: int, n: int) -> Column:
        return F.decode(F.substring(F.encode(value(x), "UTF-8"), start + 1, n), "UTF-8")

    def trim(self, x: Any, chars: str | None = None) -> Column:
        return F.btrim(value(x)) if chars is None else F.btrim(value(x), F.lit(chars))

    def ltrim(self, x: Any, chars: str | None = None) -> Column:
        return F.ltrim(value(x)) if chars is None else F.ltrim(value(x), F.lit(chars))

    def rtrim(self, x: Any, chars: str | None = None) -> Column:
        return F.rtrim(value(x)) if chars is None else F.rtrim(value(x), F.lit(chars))

    def split(self, x: Any, delimiter: str) -> Column:
        return F.split(value(x), re.escape(delimiter), -1)

    def str_len_cp(self, x: Any) -> Column:
        return F.char_length(value(x))

    def str_len_bytes(self, x: Any) -> Column:
        return F.octet_length(value(x))

    def regex_match(self, x: Any, pattern: str) -> Column:
        return F.coalesce(value(x).rlike(pattern), F.lit(False))

    def regex_find(self, x: Any, pattern: str) -> Column:
        """{match, idx, captures} of the first match, or null. idx counts characters from 0."""
        x, groups = value(x), re.compile(pattern).groups
        captures = F.array(*[F.regexp_extract(x, pattern, i + 1) for i in range(groups)]) if groups else F.array().cast("array<string>")
        match = F.regexp_extract(x, pattern, 0)
        head = F.regexp_extract(x, f"(?s)^(.*?)(?:{pattern})", 1)
        return F.when(x.rlike(pattern), F.struct(match.alias("match"), F.char_length(head).alias("idx"), captures.alias("captures")))

    def regex_find_all(self, x: Any, pattern: str) -> Column:
        """An array of {match} of all matches."""
        return F.transform(F.regexp_extract_all(value(x), F.lit(f"({pattern})"), F.lit(1)), lambda m: F.struct(m.alias("match")))

    def replace_one(self, x: Any, find: str, new: str) -> Column:
        x, at = value(x), F.locate(find, value(x))
        return F.when(at > 0, F.concat(F.substring(x, F.lit(1), at - 1), F.lit(new), x.substr(at + len(find), F.char_length(x)))).otherwise(x)

    def replace_all(self, x: Any, find: str, new: str) -> Column:
        return F.replace(value(x), F.lit(find), F.lit(new))

    # conditions
    def cond(self, test: Any, then: Any, else_: Any) -> Column:
        return F.when(F.coalesce(value(test), F.lit(False)), value(then)).otherwise(value(else_))

    def switch(self, *branches: tuple[Any, Any], default: Any = None) -> Column:
        out = F.when(value(branches[0][0]), value(branches[0][1]))
        for test, then in branches[1:]:
            out = out.when(value(test), value(then))
        return out.otherwise(value(default)) if default is not None else out

    def literal(self, x: Any) -> Column:
        return F.lit(x)

    # dates
    def year(self, x: Any) -> Column:
        return F.year(value(x))

    def month(self, x: Any) -> Column:
        return F.month(value(x))

    def day_of_month(self, x: Any) -> Column:
        return F.dayofmonth(value(x))

    def hour(self, x: Any) -> Column:
        return F.hour(value(x))

    def minute(self, x: Any) -> Column:
        return F.minute(value(x))

    def second(self, x: Any) -> Column:
        return F.second(value(x))

    def millisecond(self, x: Any) -> Column:
        return F.pmod(F.unix_millis(value(x).cast("timestamp")), F.lit(1000)).cast("int")

    def date_to_string(self, x: Any, format: str) -> Column:
        return F.date_format(value(x), date_pattern(format))

    def date_from_string(self, x: Any, format: str | None = None, on_error: Any = None, on_null: Any = None) -> Column:
        x = value(x)
        found = F.try_to_timestamp(x, F.lit(date_pattern(format))) if format else F.try_to_timestamp(x)
        return F.when(x.isNull(), value(on_null)).otherwise(F.coalesce(found, value(on_error)))

    def date_diff(self, start: Any, end: Any, unit: str) -> Column:
        """How many boundaries of the unit lie between."""
        a, b = (F.date_trunc(unit, value(x)) for x in (start, end))
        return F.timestamp_diff(unit.upper(), a, b)

    def date_add(self, x: Any, unit: str, amount: int) -> Column:
        return F.timestamp_add(unit.upper(), F.lit(amount), value(x))

    def date_subtract(self, x: Any, unit: str, amount: int) -> Column:
        return self.date_add(x, unit, -amount)

    def date_trunc(self, x: Any, unit: str, bin_size: int = 1) -> Column:
        """Bins of several seconds, minutes, hours or days count from 2000-01-01."""
        x = value(x)
        if bin_size == 1:
            return F.date_trunc(unit, x)
        size = bin_size * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit]
        from_start = F.unix_seconds(x.cast("timestamp")) - 946684800
        return F.timestamp_seconds(F.floor(from_start / size) * size + 946684800)

    # comparisons
    def cmp(self, a: Any, b: Any) -> Column:
        return _compare(a, b)

    def eq(self, a: Any, b: Any) -> Column:
        return value(a).eqNullSafe(value(b))

    def ne(self, a: Any, b: Any) -> Column:
        return ~value(a).eqNullSafe(value(b))

    def gt(self, a: Any, b: Any) -> Column:
        return _compare(a, b) > 0

    def gte(self, a: Any, b: Any) -> Column:
        return _compare(a, b) >= 0

    def lt(self, a: Any, b: Any) -> Column:
        return _compare(a, b) < 0

    def lte(self, a: Any, b: Any) -> Column:
        return _compare(a, b) <= 0

    # arrays
    def size(self, x: Any) -> Column:
        return F.array_size(value(x))

    def array_elem_at(self, x: Any, i: int) -> Column:
        return F.try_element_at(value(x), F.lit(i + 1 if i >= 0 else i))

    def concat_arrays(self, *xs: Any) -> Column:
        return F.concat(*map(value, xs))

    def first_elem(self, x: Any) -> Column:
        return F.try_element_at(value(x), F.lit(1))

    def last_elem(self, x: Any) -> Column:
        return F.try_element_at(value(x), F.lit(-1))

    def is_in(self, x: Any, array: Any) -> Column:
        return F.coalesce(F.array_contains(value(array), value(x)), F.lit(False))

    def index_of_array(self, array: Any, x: Any) -> Column:
        """From 0; -1 if absent."""
        return (F.array_position(value(array), value(x)) - 1).cast("int")

    def is_array(self, x: Any) -> Column:
        return F.typeof(value(x)).startswith("array")

    def reverse_array(self, x: Any) -> Column:
        return F.reverse(value(x))

    def slice(self, x: Any, n: int, start: int | None = None) -> Column:
        x = value(x)
        if start is not None:
            return F.slice(x, F.lit(start + 1 if start >= 0 else start), F.lit(n))
        return F.slice(x, F.lit(1), F.lit(n)) if n >= 0 else F.slice(x, -F.least(F.lit(-n), F.greatest(F.array_size(x), F.lit(1))), F.lit(-n))

    def zip(self, *arrays: Any, longest: bool = False) -> Column:
        """Arrays of the i-th elements, as many as the shortest input has, or the longest with nulls."""
        cols = [value(a) for a in arrays]
        sizes = [F.array_size(c) for c in cols]
        n = (F.greatest if longest else F.least)(*sizes) if len(sizes) > 1 else sizes[0]
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.array(*[F.get(c, i) for c in cols]))

    def range(self, start: Any, end: Any, step: int = 1) -> Column:
        a, b = value(start), value(end)
        some = a < b if step > 0 else a > b
        last = b - 1 if step > 0 else b + 1
        return F.when(some, F.sequence(a, last, F.lit(step))).otherwise(F.array().cast("array<int>"))

    def filter(self, x: Any, test: Callable[[Column], Column]) -> Column:
        return F.filter(value(x), test)

    def map(self, x: Any, each: Callable[[Column], Column]) -> Column:
        return F.transform(value(x), each)

    def reduce(self, x: Any, initial: Any, step: Callable[[Column, Column], Column]) -> Column:
        return F.aggregate(value(x), value(initial), step)

    def let(self, names: dict[str, Any], body: Callable[..., Column]) -> Column:
        return body(**{k: value(v) for k, v in names.items()})

    # sets
    def set_union(self, a: Any, b: Any) -> Column:
        return F.array_union(value(a), value(b))

    def set_intersection(self, a: Any, b: Any) -> Column:
        return F.array_intersect(value(a), value(b))

    def set_difference(self, a: Any, b: Any) -> Column:
        return F.array_except(value(a), value(b))

    def set_equals(self, a: Any, b: Any) -> Column:
        return F.array_sort(F.array_distinct(value(a))) == F.array_sort(F.array_distinct(value(b)))

    def set_is_subset(self, a: Any, b: Any) -> Column:
        return F.array_size(F.array_except(value(a), value(b))) == 0

    def any_element_true(self, x: Any) -> Column:
        return F.exists(value(x), lambda v: F.coalesce(v.cast("boolean"), F.lit(False)))

    def all_elements_true(self, x: Any) -> Column:
        return F.forall(value(x), lambda v: F.coalesce(v.cast("boolean"), F.lit(False)))

    # types
    def type_of(self, x: Any) -> Column:
        name = F.typeof(value(x))
        out = F.when(value(x).isNull(), "null").when(name.startswith("array"), "array").when(name.startswith("struct") | name.startswith("map"), "object").when(name.startswith("decimal"), "decimal")
        for spark, document in TYPE_NAMES.items():
            out = out.when(name == spark, document)
        return out.otherwise(name)

    def convert(self, x: Any, to: str, on_error: Any = None, on_null: Any = None) -> Column:
        kind = {v: k for k, v in TYPE_NAMES.items()} | {"double": "double", "date": "timestamp", "decimal": "decimal(38,18)"}
        x = value(x)
        return F.when(x.isNull(), value(on_null)).otherwise(F.coalesce(x.try_cast(kind.get(to, to)), value(on_error)))

    def to_int(self, x: Any) -> Column:
        return value(x).cast("int")

    def to_long(self, x: Any) -> Column:
        return value(x).cast("bigint")

    def to_double(self, x: Any) -> Column:
        return value(x).cast("double")

    def to_decimal(self, x: Any) -> Column:
        return value(x).cast(T.DecimalType(38, 18))

    def to_string(self, x: Any) -> Column:
        return value(x).cast("string")

    def to_object_id(self, x: Any) -> Column:
        """24 hexadecimal digits, in lower case; anything else is an error."""
        x = value(x).cast("string")
        return F.when(x.isNull() | x.rlike("^[0-9a-fA-F]{24}$"), F.lower(x)).otherwise(F.raise_error(F.lit("not an object id")))

    def to_bool(self, x: Any) -> Column:
        return value(x).cast("boolean")

    def to_date(self, x: Any) -> Column:
        return F.to_timestamp(value(x))

    def millis_to_date(self, x: Any) -> Column:
        return F.timestamp_millis(value(x))

    # objects
    def object_to_array(self, x: Any, fields: list[str] | None = None) -> Column:
        """Arrays of {k, v}, of a map, or of the named fields (of one type) of a struct."""
        x = value(x)
        if fields is not None:
            return F.array(*[F.struct(F.lit(k).alias("k"), x.getField(k).alias("v")) for k in fields])
        return F.transform(F.map_entries(x), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))

    def array_to_object(self, x: Any) -> Column:
        return F.map_from_entries(value(x))

    def get_field(self, x: Any, name: str) -> Column:
        return value(x).getField(name)

    def set_field(self, x: Any, name: str, new: Any) -> Column:
        return value(x).withField(name, value(new))

    def merge_objects(self, *fields_of: tuple[Any, list[str]]) -> Column:
        """Structs with their field names; of equal names the last wins."""
        owner = {k: value(x).getField(k) for x, names in fields_of for k in names}
        return F.struct(*[c.alias(k) for k, c in owner.items()])


fn = _Expressions()


def operator(name: str, *args: Any, **named: Any) -> Column:
    """Any expression by its document name: operator('$strLenCP', '$title')."""
    plain = {"first": "first_elem", "last": "last_elem", "in": "is_in", "type": "type_of"}
    name = name.lstrip("$")
    found = plain.get(name) or re.sub(r"(?<=[a-z])(CP|[A-Z])", lambda m: "_" + m[1].lower(), name)
    if not hasattr(_Expressions, found):
        raise ValueError(f"unknown operator ${name}")
    return getattr(fn, found)(*args, **named)


@dataclass(frozen=True)
class Rows:
    """The rows that an accumulator reads: df, and the ordering they come in (a struct column), for groups."""

    df: DataFrame
    order: Column

    def key(self, spec: dict[str, int]) -> Column:
        return sort_key(self.df, spec)


class Accumulator:
    """An aggregate over rows and what is made of its value, apart, so that the aggregate can stand over a window too."""

    def __init__(self, build: Callable[[Rows], Column], wrap: Callable[[Column], Column] = lambda c: c, windowed: Callable[[Rows], Column] | None = None, window_wrap: Callable[[Column], Column] | None = None):
        self._build, self._wrap, self._windowed, self._window_wrap = build, wrap, windowed or build, window_wrap or wrap

    def grouped(self, rows: Rows) -> Column:
        return self._wrap(self._build(rows))

    def over(self, rows: Rows, window: WindowSpec) -> Column:
        """Over a window, whose own order counts."""
        return self._window_wrap(self._windowed(rows).over(window))


def descending(c: Column, kind: T.DataType) -> Column:
    """A value that sorts the other way round, for any type that has an order."""
    if isinstance(kind, T.StringType | T.BinaryType):
        # complements of the hexadecimal digits; the end sorts after all of them
        return F.concat(F.translate(F.hex(c.cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    if isinstance(kind, T.IntegralType):
        return F.bitwise_not(c.cast("long"))
    if isinstance(kind, T.FractionalType | T.DecimalType):
        return -c
    if isinstance(kind, T.BooleanType):
        return ~c
    if isinstance(kind, T.DateType):
        return -F.unix_date(c)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return -F.unix_micros(c.cast("timestamp"))
    raise TypeError(f"{kind.simpleString()} has no descending order")


def sort_key(df: DataFrame, spec: dict[str, int]) -> Column:
    """A struct that sorts as the spec does. Null is the lowest value: first ascending, last descending."""
    parts = []
    for i, (name, way) in enumerate(spec.items()):
        c = F.col(name)
        parts.append((c.isNotNull() if way > 0 else c.isNull()).alias(f"n{i}"))
        parts.append((c if way > 0 else descending(c, df.select(c).schema[0].dataType)).alias(f"k{i}"))
    return F.struct(*parts)


def _boxed(x: Any) -> Column:
    """In a struct, so that aggregates do not leave nulls out."""
    return F.struct(value(x).alias("v"))


def _unboxed(c: Column) -> Column:
    return F.transform(c, lambda e: e["v"])


def _listed(x: Any, cut: Callable[[Column], Column] = lambda c: c, key: Callable[[Rows], Column] | None = None) -> Accumulator:
    """The values in order, nulls included: the order of the rows, or by a key of their own."""
    pairs = lambda rows: F.collect_list(F.struct((key(rows) if key else rows.order).alias("o"), _boxed(x).alias("w")))
    ordered = lambda c: cut(F.transform(F.array_sort(c), lambda e: e["w"]["v"]))
    if key:
        return Accumulator(pairs, ordered)
    return Accumulator(pairs, ordered, lambda rows: F.collect_list(_boxed(x)), lambda c: cut(_unboxed(c)))


def _end(c: Column, n: int) -> Column:
    """The last n elements."""
    return F.reverse(F.slice(F.reverse(c), 1, n))


class _Accumulators:
    def sum(self, x: Any) -> Accumulator:
        """Of nothing: 0."""
        return Accumulator(lambda _: F.sum(value(x)), lambda c: F.coalesce(c, F.lit(0)))

    def avg(self, x: Any) -> Accumulator:
        return Accumulator(lambda _: F.avg(value(x)))

    def min(self, x: Any) -> Accumulator:
        return Accumulator(lambda _: F.min(value(x)))

    def max(self, x: Any) -> Accumulator:
        return Accumulator(lambda _: F.max(value(x)))

    def first(self, x: Any) -> Accumulator:
        return Accumulator(lambda rows: F.min_by(_boxed(x), rows.order), lambda c: c["v"], lambda _: F.first(_boxed(x)))

    def last(self, x: Any) -> Accumulator:
        return Accumulator(lambda rows: F.max_by(_boxed(x), rows.order), lambda c: c["v"], lambda _: F.last(_boxed(x)))

    def push(self, x: Any) -> Accumulator:
        return _listed(x)

    def add_to_set(self, x: Any) -> Accumulator:
        return Accumulator(lambda _: F.collect_set(_boxed(x)), lambda c: F.array_sort(_unboxed(c)))

    def count(self) -> Accumulator:
        return Accumulator(lambda _: F.count(F.lit(1)))

    def std_dev_pop(self, x: Any) -> Accumulator:
        return Accumulator(lambda _: F.stddev_pop(value(x)))

    def std_dev_samp(self, x: Any) -> Accumulator:
        return Accumulator(lambda _: F.stddev_samp(value(x)))

    def first_n(self, x: Any, n: int) -> Accumulator:
        return _listed(x, lambda c: F.slice(c, 1, n))

    def last_n(self, x: Any, n: int) -> Accumulator:
        return _listed(x, lambda c: _end(c, n))

    def max_n(self, x: Any, n: int) -> Accumulator:
        """Nulls do not count."""
        return Accumulator(lambda _: F.collect_list(value(x)), lambda c: F.slice(F.sort_array(c, asc=False), 1, n))

    def min_n(self, x: Any, n: int) -> Accumulator:
        return Accumulator(lambda _: F.collect_list(value(x)), lambda c: F.slice(F.array_sort(c), 1, n))

    def top(self, sort: dict[str, int], output: Any) -> Accumulator:
        return Accumulator(lambda rows: F.min_by(_boxed(output), rows.key(sort)), lambda c: c["v"])

    def bottom(self, sort: dict[str, int], output: Any) -> Accumulator:
        return Accumulator(lambda rows: F.max_by(_boxed(output), rows.key(sort)), lambda c: c["v"])

    def top_n(self, n: int, sort: dict[str, int], output: Any) -> Accumulator:
        return _listed(output, lambda c: F.slice(c, 1, n), lambda rows: rows.key(sort))

    def bottom_n(self, n: int, sort: dict[str, int], output: Any) -> Accumulator:
        return _listed(output, lambda c: _end(c, n), lambda rows: rows.key(sort))


acc = _Accumulators()


# filters


_KINDS = (
    (bool, T.BooleanType),
    (int | float | decimal.Decimal, T.NumericType),
    (str, T.StringType),
    (datetime.date | datetime.datetime, T.DateType | T.TimestampType | T.TimestampNTZType),
    (bytes | bytearray, T.BinaryType),
    (list | tuple, T.ArrayType),
    (dict, T.StructType | T.MapType),
)


def same_kind(x: Any, kind: T.DataType | None) -> bool:
    """Whether a value can be compared with a column of this type: documents compare values of one kind only."""
    if kind is None or isinstance(x, Column) or (isinstance(x, str) and x.startswith("$")):
        return True
    for mine, theirs in _KINDS:
        if isinstance(x, mine):
            return isinstance(kind, theirs)
    return False


def field_filter(name: str, op: str, x: Any = None, df: DataFrame | None = None) -> Column:
    """One field against one value: true or false, never null.

    With df, a value of another kind than the field matches nothing, and a field that is an array matches if an element does.
    """
    c, no = F.col(name), F.lit(False)
    kind = df.select(c).schema[0].dataType if df is not None else None
    if isinstance(kind, T.ArrayType) and op in ("$eq", "$gt", "$gte", "$lt", "$lte", "$in", "$regex") and not isinstance(x if op != "$in" else None, list | tuple) and x is not None:
        return F.coalesce(F.exists(c, lambda e: _matches(e, op, x, kind.elementType)), no)
    if isinstance(kind, T.ArrayType) and op in ("$ne", "$nin"):
        return ~field_filter(name, {"$ne": "$eq", "$nin": "$in"}[op], x, df)
    match op:
        case "$ne":
            return ~_matches(c, "$eq", x, kind)
        case "$nin":
            return ~_matches(c, "$in", x, kind)
        case "$exists":
            return c.isNotNull() if x else c.isNull()
        case "$type":
            return fn.type_of(c) == x
        case "$size":
            return F.coalesce(F.array_size(c) == x, no)
        case "$all":
            return F.coalesce(F.array_size(F.array_except(value(list(x)), c)) == 0, no)
        case "$elemMatch":
            return F.coalesce(F.exists(c, x), no)
        case "$not":
            return ~document_filter({name: x}, df)
    return _matches(c, op, x, kind)


def _matches(c: Column, op: str, x: Any, kind: T.DataType | None) -> Column:
    no = F.lit(False)
    if op not in ("$eq", "$gt", "$gte", "$lt", "$lte", "$in", "$regex"):
        raise ValueError(f"unknown filter operator {op}")
    if op == "$in":
        listed = [v for v in x if v is not None and same_kind(v, kind)]
        found = F.coalesce(c.isin(*listed), no) if listed else no
        return found | c.isNull() if None in x else found
    if x is not None and not same_kind(x, kind):
        return no
    v = value(x)
    match op:
        case "$eq":
            return c.eqNullSafe(v)
        case "$gt" | "$gte" | "$lt" | "$lte":
            return F.coalesce({"$gt": c > v, "$gte": c >= v, "$lt": c < v, "$lte": c <= v}[op], no)
    return F.coalesce(c.rlike(x), no)


def document_filter(spec: Any, df: DataFrame | None = None) -> Column:
    """A filter document ({field: value or {op: value}}, $and, $or, $nor, $expr), or a Column. df: the documents, for their types."""
    if isinstance(spec, Column):
        return F.coalesce(spec, F.lit(False))
    out = F.lit(True)
    for k, v in spec.items():
        if k == "$and":
            part = F.lit(True)
            for s in v:
                part = part & document_filter(s, df)
        elif k in ("$or", "$nor"):
            part = F.lit(False)
            for s in v:
                part = part | document_filter(s, df)
            part = ~part if k == "$nor" else part
        elif k == "$expr":
            part = F.coalesce(value(v), F.lit(False))
        elif isinstance(v, dict) and any(o.startswith("$") for o in v):
            part = F.lit(True)
            for op, x in v.items():
                part = part & field_filter(k, op, x, df)
        else:
            part = field_filter(k, "$eq", v, df)
        out = out & part
    return out
