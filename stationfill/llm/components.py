"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationfill.llm.common import Scratch


def _hook(edges: DataFrame, key: str, scratch: Scratch, name: str) -> DataFrame:
    """Each edge with the smallest neighbour of its `key` end, that end itself included.

    The minima are a table of their own, so that adaptive execution can split the partition of a vertex with very many edges.
    """
    other = "v" if key == "u" else "u"
    least = scratch.save(edges.groupBy(key).agg(F.least(F.min(other), F.col(key)).alias("m")), name)
    return edges.join(least, key)


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v) are stars already: every u has one edge, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component) for every vertex of edges (a, b), component being the smallest vertex that links reach.

    Nothing is collected but whether a round was the last; the rounds are as many as the square of the logarithm of the
    vertices at most, and each removes the tables of the one before. An empty table of edges gives an empty result; loops and repeats are harmless.
    """
    pair = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, k = scratch.save(pair.distinct(), f"{name}-0"), 0
    while not _settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = _hook(both, "u", scratch, f"{name}-{k}-large").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        wide = scratch.save(wide.filter("u <> v").distinct(), f"{name}-{k}-wide")
        low = _hook(wide, "u", scratch, f"{name}-{k}-small")
        links = low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = scratch.save(links.filter("u <> v").distinct(), f"{name}-{k + 1}")
        scratch.drop(f"{name}-{k}", *(f"{name}-{k}-{x}" for x in ("large", "wide", "small")))
        k += 1
    roots = now.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    found = scratch.save(now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots), f"{name}-out")
    scratch.drop(f"{name}-{k}")
    return found


def joined_components(found: DataFrame, more: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The components `found` (id, component) after further edges (a, b): only the components are linked anew, not their members."""
    a, b = (found.select(F.col("id").alias(k), F.col("component").alias(f"c{k}")) for k in "ab")
    named = more.select("a", "b").join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    between = components(scratch.save(named.distinct(), f"{name}-named"), scratch, name).select(F.col("id").alias("component"), F.col("component").alias("whole"))
    moved = found.join(between, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
    new = between.join(found.select(F.col("id").alias("component")), "component", "left_anti").select(F.col("component").alias("id"), F.col("whole").alias("component"))
    joined = scratch.save(moved.unionByName(new), f"{name}-joined")
    scratch.drop(f"{name}-named", f"{name}-out")
    return joined
