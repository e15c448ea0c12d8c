"""Connected components by random-mate contraction: rounds of joins and aggregations, no group in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrament.session import Scratch, lookup


def components(edges: DataFrame, scratch: Scratch, seed: int = 17) -> DataFrame:
    """Edges (u, v) to labels (v, root) of every vertex that has an edge to another one.

    Each round throws a coin per vertex, joins tails into their least heads neighbour and relabels the edges, until none
    is left; labels are then unwound from the last round to the first. Null ends and loops are ignored.
    """
    both = edges.select("u", "v").where("u <> v")
    edges, n = scratch.count(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    merged, r = [], 0
    while n:
        heads = lambda c, r=r: F.expr(f"xxhash64({c}, {seed}L, {r}L) & 1L") == 1
        mates, m = scratch.count(edges.where(~heads("u") & heads("v")).groupBy("u").agg(F.min("v").alias("p")))
        r += 1
        if not m:
            continue
        merged.append(mates)
        moved = lookup(edges, mates, "u", rows=m).select(F.coalesce("p", "u").alias("u"), "v")
        moved = lookup(moved, mates.withColumnRenamed("u", "v"), "v", rows=m).select("u", F.coalesce("p", "v").alias("v"))
        old = edges
        edges, n = scratch.count(moved.where("u <> v").distinct())
        scratch.drop(old)
    labels = None
    for k, mates in enumerate(reversed(merged)):
        if labels is None:
            labels = mates.select(F.col("u").alias("v"), F.col("p").alias("root"))
            continue
        up = labels.select(F.col("v").alias("p"), "root")
        labels = labels.unionByName(lookup(mates, up, "p").select(F.col("u").alias("v"), F.coalesce("root", "p").alias("root")))
        if k % 4 == 3:
            labels = scratch.keep(labels)
    if labels is None:
        return scratch.spark.createDataFrame([], edges.select("v", F.col("v").alias("root")).schema)
    labels = scratch.keep(labels)
    return labels.union(labels.select("root", "root").distinct())
