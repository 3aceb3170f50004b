"""Copy-on-write mutations: (table, change) -> (new table, affected rows). Nothing is written until the caller writes it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Changed:
    """table: the new table. rows: the affected rows, as RETURNING gives them."""

    table: DataFrame
    rows: DataFrame

    def returning(self, *columns: str) -> DataFrame:
        return self.rows.select(*columns) if columns else self.rows


def insert(table: DataFrame, rows: list[dict[str, Any]], defaults: dict[str, Any] | None = None) -> Changed:
    """Append rows; columns that a row leaves out get their default (a value, or a function called once for each row), or null."""
    defaults = defaults or {}
    unknown = {k for r in rows for k in r} - set(table.columns)
    if unknown:
        raise KeyError(f"unknown columns {sorted(unknown)}")

    def cell(row: dict, name: str) -> Any:
        if name in row:
            return row[name]
        d = defaults.get(name)
        return d() if callable(d) else d

    new = table.sparkSession.createDataFrame([tuple(cell(r, c) for c in table.columns) for r in rows], table.schema)
    return Changed(table.unionByName(new), new)


def update(table: DataFrame, values: dict[str, Any], where: Column | None = None, on_update: dict[str, Any] | None = None) -> Changed:
    """Set columns where the predicate is true; values may be Columns of the old row. on_update fills columns not set."""
    if not values:
        return Changed(table, table.limit(0))
    values = (on_update or {}) | values
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    new = {k: (v if isinstance(v, Column) else F.lit(v)).cast(table.schema[k].dataType) for k, v in values.items()}
    changed = [new.get(c, F.col(c)).alias(c) for c in table.columns]
    mixed = [F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns]
    return Changed(table.select(*mixed), table.where(hit).select(*changed))


def delete(table: DataFrame, where: Column | None = None) -> Changed:
    """Rows for which the predicate is false or null stay."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    return Changed(table.where(~hit), table.where(hit))


def _one(table: DataFrame, where: Column, key: list[str]) -> Column:
    """A predicate for the first matching row by key."""
    row = table.where(where).orderBy(*key).select(*key).first()
    if row is None:
        return F.lit(False)
    out = F.lit(True)
    for k in key:
        out = out & F.col(k).eqNullSafe(F.lit(row[k]))
    return out


def update_one(table: DataFrame, values: dict[str, Any], where: Column, key: list[str]) -> Changed:
    return update(table, values, _one(table, where, key))


def delete_one(table: DataFrame, where: Column, key: list[str]) -> Changed:
    return delete(table, _one(table, where, key))


def merge_rows(target: DataFrame, rows: DataFrame, on: list[str], when_matched: str = "merge", when_not_matched: str = "insert", update_columns: list[str] | None = None) -> DataFrame:
    """Upsert by one full outer join. replace: the new row; merge: its columns over the old; keepExisting: nothing; fail: an error.

    update_columns: only these change in matched rows. A key must not occur twice among the new rows.
    """
    names = [*target.columns, *[c for c in rows.columns if c not in target.columns]]
    old = target.select(*on, F.struct(*target.columns).alias("_old"))
    new = rows.select(*on, F.struct(*rows.columns).alias("_new"))
    if when_not_matched == "discard":
        joined = old.join(new, on, "left")
    else:
        joined = old.join(new, on, "full")
    both, added = F.col("_old").isNotNull() & F.col("_new").isNotNull(), F.col("_old").isNull()
    for state, how in ((both, when_matched), (added, when_not_matched)):
        if how == "fail":
            joined = joined.where(F.when(state, F.raise_error(F.lit("merge found a row it must not"))).otherwise(F.lit(True)))

    def cell(c: str) -> Column:
        was = F.col("_old")[c] if c in target.columns else F.lit(None)
        now = F.col("_new")[c] if c in rows.columns else F.lit(None)
        changes = c in rows.columns and (update_columns is None or c in update_columns or c in on)
        matched = was
        if when_matched == "replace" or (when_matched == "merge" and changes):
            matched = now
        return F.when(both, matched).when(added, now).otherwise(was).alias(c)

    return joined.select(*[cell(c) for c in names])


def upsert(table: DataFrame, create: dict[str, Any], update_values: dict[str, Any], on: list[str], defaults: dict[str, Any] | None = None) -> Changed:
    """Insert the row, or update the row with the same key; an empty update leaves it as it is."""
    same = F.lit(True)
    for k in on:
        same = same & F.col(k).eqNullSafe(F.lit(create[k]))
    if table.where(same).isEmpty():
        return insert(table, [create], defaults)
    return update(table, update_values, same) if update_values else Changed(table, table.where(same))


def insert_on_conflict(table: DataFrame, rows: list[dict[str, Any]], on: list[str], do_update: list[str] | None = None, defaults: dict[str, Any] | None = None) -> DataFrame:
    """ON CONFLICT DO NOTHING, or DO UPDATE SET the named columns to the new values."""
    new = insert(table, rows, defaults).rows
    return merge_rows(table, new, on, "keepExisting" if do_update is None else "merge", "insert", do_update)


def _path(name: str, change: Callable[[Column], Column]) -> tuple[str, Column]:
    """A change at a dotted path, as a change of its top column."""
    top, _, rest = name.partition(".")
    if not rest:
        return top, change(F.col(top))
    at = F.col(top)
    for step in rest.split("."):
        at = at.getField(step)
    return top, F.col(top).withField(rest, change(at))


#: The field updates of documents: operator -> (current value, argument) -> new value.
FIELD_UPDATES: dict[str, Callable[[Column, Any], Column]] = {
    "$set": lambda c, v: v if isinstance(v, Column) else F.lit(v),
    "$inc": lambda c, v: F.coalesce(c, F.lit(0)) + v,
    "$mul": lambda c, v: F.coalesce(c, F.lit(0)) * v,
    "$min": lambda c, v: F.least(c, F.lit(v)),
    "$max": lambda c, v: F.greatest(c, F.lit(v)),
    "$push": lambda c, v: F.array_append(F.coalesce(c, F.array()), F.lit(v)),
    "$addToSet": lambda c, v: F.when(F.array_contains(c, v), c).otherwise(F.array_append(c, F.lit(v))),
    "$pop": lambda c, v: F.slice(c, F.lit(1 if v > 0 else 2), F.greatest(F.array_size(c) - 1, F.lit(0))),
    "$pull": lambda c, v: F.filter(c, v) if callable(v) else F.filter(c, lambda x: ~x.eqNullSafe(F.lit(v))),
    "$pullAll": lambda c, v: F.filter(c, lambda x: ~F.coalesce(x.isin(*v), F.lit(False))),
    "$currentDate": lambda c, v: F.current_timestamp(),
}


def update_documents(table: DataFrame, changes: dict[str, dict[str, Any]], where: Column | None = None) -> Changed:
    """Field updates {operator: {path: argument}} of the matching documents; also $unset (a column or field to null) and $rename (columns).

    With $pull, a function keeps the elements for which it is true. $setOnInsert has no effect on documents that exist.
    """
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    df = table.withColumn("_hit", hit)
    for op, fields in changes.items():
        if op == "$setOnInsert":
            continue
        for name, arg in fields.items():
            if op == "$rename":
                df = df.withColumn(arg, F.when(F.col("_hit"), F.col(name))) if arg not in df.columns else df.withColumn(arg, F.when(F.col("_hit"), F.col(name)).otherwise(F.col(arg)))
                df = df.withColumn(name, F.when(~F.col("_hit"), F.col(name)))
                continue
            if op == "$unset":
                top, new = _path(name, lambda c: F.lit(None))
            elif op in FIELD_UPDATES:
                top, new = _path(name, lambda c, op=op, arg=arg: FIELD_UPDATES[op](c, arg))
            else:
                raise ValueError(f"unknown update operator {op}")
            if top not in df.columns:
                df = df.withColumn(top, F.when(F.col("_hit"), new))
            else:
                df = df.withColumn(top, F.when(F.col("_hit"), new.cast(df.schema[top].dataType)).otherwise(F.col(top)))
    return Changed(df.drop("_hit"), df.where("_hit").drop("_hit"))


def update_with_stages(table: DataFrame, stages: Callable, where: Column) -> Changed:
    """Run pipeline stages over the matching rows and put them back."""
    from ..plans.pipeline import Pipeline

    hit = F.coalesce(where, F.lit(False))
    rows = stages(Pipeline(table.where(hit))).df
    return Changed(table.where(~hit).unionByName(rows, allowMissingColumns=True), rows)


# the commands of documents


def _first(table: DataFrame, where: Column, sort: dict[str, int] | None, key: list[str]) -> Column:
    """A predicate for the first matching document by sort, then key."""
    from ..plans.pipeline import Pipeline

    rows = Pipeline(table.where(F.coalesce(where, F.lit(False)))).sort((sort or {}) | {k: 1 for k in key if k not in (sort or {})}).df
    row = rows.select(*key).first()
    if row is None:
        return F.lit(False)
    out = F.lit(True)
    for k in key:
        out = out & F.col(k).eqNullSafe(F.lit(row[k]))
    return out


def insert_many(table: DataFrame, documents: list[dict[str, Any]]) -> Changed:
    return insert(table, documents)


def insert_one(table: DataFrame, document: dict[str, Any]) -> Changed:
    return insert(table, [document])


def update_many(table: DataFrame, where: Column, changes: dict[str, dict[str, Any]]) -> Changed:
    return update_documents(table, changes, where)


def delete_many(table: DataFrame, where: Column) -> Changed:
    return delete(table, where)


def find_one_and_update(table: DataFrame, where: Column, changes: dict[str, dict[str, Any]], key: list[str], sort: dict[str, int] | None = None, before: bool = False) -> Changed:
    """Change the first matching document; rows has it as it is now, or as it was before."""
    one = _first(table, where, sort, key)
    changed = update_documents(table, changes, one)
    return Changed(changed.table, table.where(one) if before else changed.rows)


def find_one_and_delete(table: DataFrame, where: Column, key: list[str], sort: dict[str, int] | None = None) -> Changed:
    """Take the first matching document out; rows has it."""
    return delete(table, _first(table, where, sort, key))


class Transaction:
    """Changes to several tables that are published together, or not at all if the block raises."""

    def __init__(self, tables: dict[str, DataFrame]):
        self._published, self._staged = tables, {}

    def __getitem__(self, name: str) -> DataFrame:
        return self._staged.get(name, self._published[name])

    def __setitem__(self, name: str, df: DataFrame) -> None:
        self._staged[name] = df

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self._published.update(self._staged)
        self._staged = {}
