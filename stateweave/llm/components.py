"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_small, materialize, spread_join


def is_star(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    ids = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not ids.agg(F.max((F.col("out") > 1) | (F.col("out") > 0) & (F.col("into") > 0))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (columns a, b, long); component is the least id that can be reached.

    Each step is written to the shared folder. A hub's links are only ever joined, never gathered, so that skewed hubs split.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not is_star(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "large-star")
        large = spread_join(both, least.select("u", "m"), "u", least, F.col("v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "small-star")
        small = spread_join(large, least.select("u", "m"), "u", least, F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.distinct(), "links")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def extended(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """``comps`` (of earlier links) joined up by more links; only links between components are followed."""
    if comps is None:
        return materialize(components(links), "components")
    named = lambda c: comps.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    between = links.join(named("a"), "a", "left").join(named("b"), "b", "left")
    between = between.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    between = materialize(between, "between")
    if between.isEmpty():
        return comps
    merged = materialize(components(between), "merged")
    names = merged.select(F.col("id").alias("component"), F.col("component").alias("to"))
    if is_small(names):
        moved = comps.join(F.broadcast(names), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    else:  # a component may hold most ids: they meet its new name in several tasks
        sizes = materialize(comps.groupBy("component").agg(F.count("*").alias("n")), "component-sizes")
        moved = spread_join(comps, names, "component", sizes, F.col("id")).select("id", F.col("to").alias("component"))
        moved = moved.unionByName(comps.join(names, "component", "left_anti").select("id", "component"))
    return materialize(moved.unionByName(merged.join(comps.select("id"), "id", "left_anti").select("id", "component")), "components")
