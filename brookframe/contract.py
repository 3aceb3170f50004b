"""The schema contract: models over tables, their relations and variants."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import types as T

ONE_TO_ONE, ONE_TO_MANY, MANY_TO_ONE, MANY_TO_MANY = "1:1", "1:N", "N:1", "N:M"


@dataclass(frozen=True)
class Relation:
    """on: pairs (local column, target column). N:M: through is the junction table, on pairs local with junction columns
    and target_on pairs junction with target columns."""

    to: str
    kind: str
    on: tuple[tuple[str, str], ...]
    through: str | None = None
    target_on: tuple[tuple[str, str], ...] = ()

    @property
    def to_many(self) -> bool:
        return self.kind in (ONE_TO_MANY, MANY_TO_MANY)


@dataclass(frozen=True)
class Variant:
    """A value of the discriminator; columns of its own in the base table, or a table joined by the key."""

    name: str
    value: str
    columns: tuple[str, ...] = ()
    table: str | None = None


@dataclass(frozen=True)
class Model:
    name: str
    table: str
    key: tuple[str, ...]
    relations: dict[str, Relation] = field(default_factory=dict)
    discriminator: str | None = None
    variants: tuple[Variant, ...] = ()
    defaults: dict = field(default_factory=dict)  # column: value or function of no arguments
    unique: tuple[tuple[str, ...], ...] = ()

    def variant(self, name: str) -> Variant:
        for v in self.variants:
            if v.name == name:
                return v
        raise KeyError(f"{self.name} has no variant {name}")


@dataclass(frozen=True)
class Contract:
    models: tuple[Model, ...]

    def model(self, name: str) -> Model:
        for m in self.models:
            if m.name == name:
                return m
        raise KeyError(f"no model {name}")

    def hash(self) -> str:
        """SHA-256 of the canonical JSON of the contract."""
        plain = [
            {"name": m.name, "table": m.table, "key": m.key, "relations": {k: vars(r) for k, r in sorted(m.relations.items())}, "discriminator": m.discriminator, "variants": [vars(v) for v in m.variants]}
            for m in sorted(self.models, key=lambda m: m.name)
        ]
        return hashlib.sha256(json.dumps(plain, sort_keys=True, default=list).encode()).hexdigest()


#: Codec names and the Spark types that hold them.
CODECS = {
    "text": T.StringType(),
    "char": T.StringType(),
    "varchar": T.StringType(),
    "enum": T.StringType(),
    "int2": T.ShortType(),
    "int4": T.IntegerType(),
    "int8": T.LongType(),
    "float4": T.FloatType(),
    "float8": T.DoubleType(),
    "numeric": T.DecimalType(38, 18),
    "bool": T.BooleanType(),
    "bit": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(),
    "time": T.StringType(),
    "interval": T.DayTimeIntervalType(),
    "json": T.VariantType(),
    "bytea": T.BinaryType(),
    "uuid": T.StringType(),
    "objectId": T.StringType(),
    "vector": T.ArrayType(T.FloatType()),
}


def traits(kind: T.DataType) -> frozenset[str]:
    """What operators a type allows: equality, order, boolean, numeric, textual."""
    if isinstance(kind, T.StringType | T.CharType | T.VarcharType):
        return frozenset({"equality", "order", "textual"})
    if isinstance(kind, T.BooleanType):
        return frozenset({"equality", "boolean"})
    if isinstance(kind, T.NumericType):
        return frozenset({"equality", "order", "numeric"})
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType | T.DayTimeIntervalType | T.YearMonthIntervalType):
        return frozenset({"equality", "order"})
    if isinstance(kind, T.VariantType | T.MapType):
        return frozenset()
    return frozenset({"equality"})


def require(kind: T.DataType, trait: str, operator: str) -> None:
    if trait not in traits(kind):
        raise TypeError(f"{operator} needs a type with {trait}, not {kind.simpleString()}")


def schema_diff(expected: T.StructType, actual: T.StructType) -> list[str]:
    """What differs: missing, extra and differently typed columns."""
    have, want = {f.name: f.dataType for f in actual}, {f.name: f.dataType for f in expected}
    out = [f"missing {n}" for n in want if n not in have] + [f"extra {n}" for n in have if n not in want]
    return out + [f"{n}: {have[n].simpleString()} instead of {want[n].simpleString()}" for n in want if n in have and have[n] != want[n]]
