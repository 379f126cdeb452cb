"""Connected components of an edge table, wholly on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .storage import Scratch


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str, max_rounds: int = 200) -> DataFrame:
    """Smallest reachable vertex of each vertex that has an edge.

    Contraction: every vertex takes the least vertex of its neighbourhood as its
    label, edges are carried over to labels, and those within one label go, so
    that each round reads only what is still apart. The least is by value and by
    a salted hash in turn, since chains of ascending values shrink by the hash
    and stars around their smallest vertex by the value. Labels are put together
    from the last round back. A hub's rows are summed by partial aggregation and
    joined to one-row sides, which Spark splits when skewed. Input columns
    ``u, v``; output ``vertex, component``. No edges give no rows.
    """
    now = scratch.write(_ordered(edges), f"{name}-edges-0")
    levels: list[DataFrame] = []
    for k in range(max_rounds):
        if now.isEmpty():
            break
        rank: Column = F.struct(F.lit(0), "v") if k % 2 == 0 else F.struct(F.xxhash64(F.lit(k), "v"), "v")
        own: Column = F.struct(F.lit(0), "u") if k % 2 == 0 else F.struct(F.xxhash64(F.lit(k), "u"), "u")
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(rank).alias("n")).select("u", F.least(F.col("n").cast("struct<r:bigint,x:bigint>"), own.cast("struct<r:bigint,x:bigint>"))["x"].alias("label"))
        levels.append(scratch.write(least, f"{name}-labels-{k}"))
        carried = now.join(levels[-1], "u").select("v", F.col("label").alias("a"))
        carried = carried.join(levels[-1].withColumnRenamed("u", "v").withColumnRenamed("label", "b"), "v")
        now = scratch.write(_ordered(carried.select(F.col("a").alias("u"), F.col("b").alias("v"))), f"{name}-edges-{k + 1}")
        scratch.drop(f"{name}-edges-{k}")
    else:
        raise RuntimeError("components did not settle")
    if not levels:
        return now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    final = levels[-1]
    for level in reversed(levels[:-1]):
        up = final.select(F.col("u").alias("label"), F.col("label").alias("top"))
        final = level.join(up, "label", "left").select("u", F.coalesce("top", "label").alias("label"))
    final = scratch.write(final, f"{name}-final")
    smallest = final.groupBy("label").agg(F.min("u").alias("component"))
    return final.join(smallest, "label").select(F.col("u").alias("vertex"), "component")


def merged(labels: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Components ``vertex, component`` after more links ``u, v``; only links between components are worked on."""
    left = labels.select(F.col("vertex").alias("u"), F.col("component").alias("a"))
    right = labels.select(F.col("vertex").alias("v"), F.col("component").alias("b"))
    between = links.join(left, "u", "left").join(right, "v", "left").select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v"))
    joined = components(between, scratch, name)
    over = joined.select(F.col("vertex").alias("component"), F.col("component").alias("now"))
    old = labels.join(over, "component", "left").select("vertex", F.coalesce("now", "component").alias("component"))
    return old.union(joined.join(labels.select("vertex"), "vertex", "left_anti").select("vertex", "component"))
