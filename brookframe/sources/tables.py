"""Sources and sinks: Parquet, JSON and JDBC tables, the catalog, and table definitions."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A collection as JSON lines."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def jdbc(spark: SparkSession, url: str, table: str, fetch_size: int = 10_000, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A database table by its JDBC driver; partition: (numeric column, low, high, number of parallel reads)."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(fetch_size), **options)
    if partition:
        column, low, high, n = partition
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(n))
    return reader.load()


def function_source(spark: SparkSession, function: str, *args: Any, alias: str, columns: list[str], ordinality: str | None = None) -> DataFrame:
    """A table function in FROM (range, explode, ...), its columns renamed, perhaps with their places from 1."""
    if not columns:
        raise ValueError("a function source needs column names")
    found = getattr(spark.tvf, function)(*args).toDF(*columns)
    if ordinality:
        if function not in ("explode", "posexplode"):
            raise ValueError("only exploded arrays have an order")
        found = spark.tvf.posexplode(*args).toDF("_pos", *columns).select(*columns, (F.col("_pos") + 1).alias(ordinality))
    return found.alias(alias)


def stream_rows(df: DataFrame, tag: str | None = None) -> Iterator[Row]:
    """Rows one partition at a time; with a tag, spark.interruptTag(tag) ends the run."""
    spark = df.sparkSession
    if tag:
        spark.addTag(tag)
    try:
        yield from df.toLocalIterator(prefetchPartitions=True)
    finally:
        if tag:
            spark.removeTag(tag)


def write(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def introspect(spark: SparkSession, database: str | None = None) -> dict[str, T.StructType]:
    """Table names of the catalog and their schemas."""
    return {t.name: spark.table(t.name).schema for t in spark.catalog.listTables(database)}


def create_table(spark: SparkSession, name: str, schema: T.StructType, if_not_exists: bool = True) -> None:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema)
    spark.sql(f"CREATE TABLE {'IF NOT EXISTS ' if if_not_exists else ''}{name} ({columns}) USING parquet")


def add_columns(spark: SparkSession, name: str, columns: dict[str, str]) -> None:
    spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'`{c}` {kind}' for c, kind in columns.items())})")


def create_namespace(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}")


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def violations(df: DataFrame, key: list[str] = (), not_null: list[str] = (), check: str | None = None, foreign: tuple[list[str], DataFrame, list[str]] | None = None) -> dict[str, DataFrame]:
    """Rows that break a constraint, by kind. Spark does not enforce keys, so these are queries."""
    out = {}
    if key:
        out["key"] = df.groupBy(*key).count().where("count > 1")
    for c in not_null:
        out[f"not null {c}"] = df.where(F.col(c).isNull())
    if check:
        out["check"] = df.where(f"NOT ({check})")
    if foreign:
        own, other, theirs = foreign
        target = other.select(*[F.col(t).alias(c) for c, t in zip(own, theirs, strict=True)])
        out["foreign key"] = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in own)).join(target, own, "left_anti")
    return out


def data_transform(df: DataFrame, before: str, change: Any, after: str) -> DataFrame:
    """A migration step: change(df), guarded by conditions that every row must meet before and after."""
    if not df.where(f"NOT ({before})").isEmpty():
        raise ValueError(f"rows do not meet {before}")
    new = change(df)
    if not new.where(f"NOT ({after})").isEmpty():
        raise ValueError(f"rows do not meet {after} afterwards")
    return new
