"""Problem 3: splits that keep related records together.

Method: random-mate contraction. The graph has the folded family and collection names as vertices; a page that carries
several names links its least name with each other one, so a name on a third of all pages adds no clique. Each round
throws a coin per vertex, joins every tails vertex into its least heads neighbour and relabels the edges, until none is
left; the labels are then unwound from the last round to the first. Groups are split by cumulative weight.

Defined cases: a null name, or one without letters and digits, shares nothing; a page without names is a group of its
own; rows with a null page_id or id are ignored, an empty table gives no rows; repeated rows count once; without targets the assigned split is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atrament.functions.fold import current_records, fold, split_name
from atrament.operators.graph import components
from atrament.session import Scratch, lookup, running_total, table

#: A group of at least this share of all weight is placed singly, largest first; there are at most 1 / LARGE of them.
LARGE = 0.005


def page_groups(records: DataFrame, scratch: Scratch) -> DataFrame:
    """records (id, page_id, work_family, collection, split, ingested_at) to one row per page:
    page_id, group_page (the group's least page), records, and splits, a mask of the group's splits (1 train, 2 val, 4 test)."""
    rows = current_records(records.where("id is not null and page_id is not null"), ["page_id", "work_family", "collection", "split"])
    code = F.element_at(F.create_map(*[F.lit(x) for kv in (("train", 1), ("val", 2), ("test", 4)) for x in kv]), split_name(F.col("split")))
    name = lambda tag, c: F.when(fold(F.col(c)) != "", F.concat(F.lit(tag), fold(F.col(c))))
    # one row for each page and pair of names: far fewer than records
    small = scratch.keep(
        rows.select("page_id", name("w:", "work_family").alias("a"), name("c:", "collection").alias("b"), F.coalesce(code, F.lit(0)).alias("m"))
        .groupBy("page_id", "a", "b")
        .agg(F.count(F.lit(1)).alias("n"), F.bit_or("m").alias("m"))
    )
    names = small.select("page_id", F.explode(F.array_compact(F.array("a", "b"))).alias("name")).distinct()
    first = names.groupBy("page_id").agg(F.min("name").alias("first"))
    edges = names.join(first, "page_id").select(F.col("first").alias("u"), F.col("name").alias("v")).distinct()
    labels = components(edges, scratch).select(F.col("v").alias("first"), "root")
    pages = small.groupBy("page_id").agg(F.sum("n").alias("records"), F.bit_or("m").alias("m")).join(first, "page_id", "left")
    pages = lookup(pages, labels, "first").withColumn("root", F.coalesce("root", "first", F.concat(F.lit("p:"), "page_id"))).select("page_id", "records", "m", "root")
    pages = scratch.keep(pages)
    groups = pages.groupBy("root").agg(F.min("page_id").alias("group_page"), F.bit_or("m").alias("splits"), F.sum("records").alias("group_records"))
    return lookup(pages.drop("m"), groups, "root").select("page_id", "group_page", "records", "group_records", "splits")


def assign(groups: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """groups (group_page, weight) to (group_page, weight, split) in the shares of targets (split, target_share).
    Large groups, a bounded number, go one by one to the split that lacks most; the others, in hashed order, fill
    what is left by their cumulative weight."""
    goal = {r.split: float(r.target_share) for r in targets.groupBy("split").agg(F.max("target_share").alias("target_share")).orderBy("split").collect() if r.split is not None and r.target_share}
    if not goal:
        return groups.select("group_page", "weight", F.lit(None).cast("string").alias("split"))
    total = groups.agg(F.sum("weight")).first()[0] or 0
    left = {s: g / sum(goal.values()) * total for s, g in goal.items()}
    bound = LARGE * total
    big = groups.where(F.col("weight") >= bound).orderBy(F.desc("weight"), "group_page").collect() if total else []
    placed = []
    for g in big:  # at most 1 / LARGE rows
        s = max(left, key=lambda s: (left[s], s))
        left[s] -= g.weight
        placed.append((g.group_page, g.weight, s))
    room = {s: max(0.0, x) for s, x in left.items()}
    rest = groups.where(F.col("weight") < bound)
    scale = rest.agg(F.sum("weight")).first()[0] or 0
    rest = running_total(rest.withColumn("_h", F.xxhash64("group_page", F.lit(5))), [F.col("_h"), F.col("group_page")], "weight", "before", scratch)
    ends, at = [], 0.0
    for s in goal:
        at += room[s] / (sum(room.values()) or 1) * scale
        ends.append((s, at))
    mid = F.col("before") + F.col("weight") / 2
    pick = F.lit(ends[-1][0])
    for s, end in reversed(ends[:-1]):
        pick = F.when(mid < end, s).otherwise(pick)
    rest = rest.select("group_page", "weight", pick.alias("split"))
    return rest.union(scratch.spark.createDataFrame(placed, rest.schema)) if placed else rest


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Scratch]:
    scratch = Scratch(spark, "groups")
    return page_groups(table(spark, sf_dir, "printed_replay_geometry"), scratch), scratch


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, _ = _pages(spark, sf_dir)
    return pages.where(F.expr("bit_count(splits) >= 2")).select("group_page", "page_id")


def p3_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: its group and the split it is assigned to."""
    pages, scratch = _pages(spark, sf_dir)
    pages = scratch.keep(pages)
    groups = pages.groupBy("group_page").agg(F.sum("records").alias("weight"))
    placed = scratch.keep(assign(groups, table(spark, sf_dir, "split_targets"), scratch))
    return lookup(pages.select("page_id", "group_page", "records"), placed.drop("weight"), "group_page")


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of records of each split."""
    got = p3_assigned(spark, sf_dir).groupBy("split").agg(F.sum("records").alias("records"), F.countDistinct("group_page").alias("groups"))
    out = table(spark, sf_dir, "split_targets").groupBy("split").agg(F.max("target_share").alias("target_share")).join(got, "split", "left")
    n = F.coalesce("records", F.lit(0))
    return out.select("split", "target_share", n.alias("records"), F.coalesce("groups", F.lit(0)).alias("groups"), (n / F.sum(n).over(Window.partitionBy())).alias("actual_share"))  # a row per split


QUERIES = {"p3_found": p3_found, "p3_assigned": p3_assigned, "p3_shares": p3_shares}

_FOLD = "nullif(regexp_replace(translate(strip_accents(lower({0})), 'ł', 'l'), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '')"
_SPLIT = "CASE WHEN lower(trim(split, ' \n\t\r')) IN ('valid', 'validation') THEN 'val' WHEN lower(trim(split, ' \n\t\r')) IN ('train', 'val', 'test') THEN lower(trim(split, ' \n\t\r')) END"

#: The twin reaches every page from every page, which only small tables bear.
SQL = {
    "p3_found": f"""WITH RECURSIVE cur AS (SELECT page_id, {_FOLD.format("work_family")} AS w, {_FOLD.format("collection")} AS c, {_SPLIT} AS s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM printed_replay_geometry) WHERE rn = 1),
n AS (SELECT DISTINCT page_id, 'w' || w AS k FROM cur WHERE w IS NOT NULL UNION SELECT DISTINCT page_id, 'c' || c FROM cur WHERE c IS NOT NULL), b AS (SELECT page_id AS u, k AS v FROM n UNION SELECT k, page_id FROM n), p AS (SELECT DISTINCT page_id FROM cur),
r(x, y) AS (SELECT page_id, page_id FROM p UNION SELECT r.x, b.v FROM r JOIN b ON r.y = b.u), g AS (SELECT x AS page_id, min(y) AS group_page FROM r WHERE y IN (SELECT page_id FROM p) GROUP BY x),
s AS (SELECT g.group_page FROM g JOIN cur USING (page_id) GROUP BY g.group_page HAVING count(DISTINCT s) >= 2) SELECT group_page, page_id FROM g WHERE group_page IN (SELECT group_page FROM s)"""
}
