"""As-of neighbours: the last anchor before and the first after each row, without a cross join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atrament.session import Scratch


def neighbours(rows: DataFrame, anchors: DataFrame, by: list[str], at: str, value: str, scratch: Scratch) -> DataFrame:
    """rows (by.., at, ..) with before_at, before_value, after_at, after_value from anchors (by.., at, value). An anchor at
    the same place counts as before.

    Rows and anchors are one union in range partitions of (by, at), so a key with a third of all rows spreads over many.
    Neighbours are found within partitions; what a partition lacks at its edges comes from a table with one row per
    partition and key.
    """
    item = F.struct(F.col(at).alias("at"), F.col(value).alias("v")).alias("_a")
    a = anchors.select(*by, at, F.lit(0).alias("_k"), item)
    row = F.struct(*rows.columns).alias("_row")
    u = a.withColumn("_row", F.lit(None).cast(rows.select(row).schema[0].dataType)).unionByName(rows.select(*by, at, F.lit(1).alias("_k"), F.lit(None).cast(a.schema["_a"].dataType).alias("_a"), row))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    u = scratch.keep(u.repartitionByRange(parts, *by, at).withColumn("_p", F.spark_partition_id()))
    inner = Window.partitionBy("_p", *by).orderBy(at, "_k")
    u = u.withColumn("_b", F.last("_a", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_n", F.first("_a", ignorenulls=True).over(inner.rowsBetween(1, Window.unboundedFollowing)))
    given = F.when(F.col("_a").isNotNull(), F.struct(at, "_k"))
    edges = u.groupBy("_p", *by).agg(F.max_by("_a", given).alias("_last"), F.min_by("_a", given).alias("_first"))
    outer = Window.partitionBy(*by).orderBy("_p")
    edges = edges.withColumn("_eb", F.last("_last", ignorenulls=True).over(outer.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_en", F.first("_first", ignorenulls=True).over(outer.rowsBetween(1, Window.unboundedFollowing)))
    same = [u["_p"] == edges["_p"], *[u[c].eqNullSafe(edges[c]) for c in by]]
    j = u.where("_k = 1").join(edges.select("_p", *by, "_eb", "_en").alias("e"), same, "left")
    b, n = F.coalesce("_b", "_eb"), F.coalesce("_n", "_en")
    return j.select("_row.*", b["at"].alias("before_at"), b["v"].alias("before_value"), n["at"].alias("after_at"), n["v"].alias("after_value"))


def interpolate(joined: DataFrame, at: str, out: str) -> DataFrame:
    """A value on the line between both neighbours; at an end, the only one's."""
    share = (F.col(at) - F.col("before_at")) / F.nullif(F.col("after_at") - F.col("before_at"), F.lit(0))
    line = F.col("before_value") + share * (F.col("after_value") - F.col("before_value"))
    return joined.withColumn(out, F.coalesce(line, "before_value", "after_value"))
