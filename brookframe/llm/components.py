"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .spread import heavy_keys, spread_join


def _turned(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame, heavy: list[tuple]) -> DataFrame:
    """Every neighbour larger than u hangs on the smallest of u and u's neighbours."""
    both = _turned(edges)
    found = spread_join(both, _minima(both), ["u"], heavy, ["v"])
    return found.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame, heavy: list[tuple]) -> DataFrame:
    """u and its smaller neighbours hang on the smallest of them; edges already point from larger to smaller."""
    least = _minima(edges)
    moved = spread_join(edges, least, ["u"], heavy, ["v"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, known: DataFrame | None = None) -> DataFrame:
    """Rows (node, component) for every node of edges (a, b); component is the smallest node reachable.

    known: rows (node, component) found before, from which to go on. Null ends and loops are ignored, repeated edges count
    once. Minima are taken by partial aggregates; where they are joined back, the edges of a node with more than a
    thousandth of all edges are dealt to many tasks.
    """
    if known is not None:
        edges = edges.select("a", "b").union(known.select(F.col("node").alias("a"), F.col("component").alias("b")))
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.write(ordered, "edges")
    while True:
        roles = now.select(F.col("u").alias("u"), F.lit(1).alias("up")).union(now.select(F.col("v").alias("u"), F.lit(0).alias("up")))
        degrees = roles.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.sum("up").alias("up"))
        # done if every node with a smaller neighbour has no other neighbour; one action tells it and the number of rows
        total, open_ = degrees.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when((F.col("up") > 0) & (F.col("n") > 1), 1))).first()
        if not open_:
            break
        last = now
        # after the large star no node has more smaller neighbours than it had neighbours before
        heavy = heavy_keys(degrees, ["u"], total)
        now = scratch.write(_small_star(_large_star(now, heavy), heavy), "edges")
        scratch.drop(last)
    # every component is now a star around its smallest node
    return scratch.write(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v"))).distinct(), "components")
