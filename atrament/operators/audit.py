"""Audits and freezes of corpora: ledgers of what a holdout excludes, sets that must be equal, orders of review, effects on scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atrament.operators.contracts import holds, violations


def split_summary(rows: DataFrame, by: list[list[str]], page: str) -> DataFrame:
    """Rows and different pages of several groupings at once; a grouping's absent columns are null."""
    cols = sorted({c for g in by for c in g})
    return rows.groupingSets([[F.col(c) for c in g] for g in by], *[F.col(c) for c in cols]).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(page).alias("pages"))


def score_impact(rows: DataFrame, system: str, frozen: str, candidate: str, hypothesis: str) -> DataFrame:
    """What a corrected reference changes: edits against the frozen and the candidate reference per system."""
    edits = lambda ref: F.sum(F.levenshtein(ref, hypothesis)).cast("bigint")
    got = rows.groupBy(system).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(frozen) != F.col(candidate)).alias("changed"), edits(frozen).alias("frozen_edits"), edits(candidate).alias("candidate_edits"))
    return got.withColumn("net", F.col("candidate_edits") - F.col("frozen_edits"))


def worst_first(rows: DataFrame, by: str, key: str, edits: Column, n: int) -> DataFrame:
    """The n rows of most edits of each group, ties by key, with their rank."""
    w = Window.partitionBy(by).orderBy(F.desc("_e"), key)
    return rows.withColumn("_e", edits).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumnRenamed("_e", "edits")


def first_seen(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Different values by where they first stand: value, first. Null is no value."""
    return rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(F.struct(*order)).alias("first"))


def freeze_holdout(rows: DataFrame, holdout: DataFrame, key: str, reasons: list[str]) -> DataFrame:
    """The ledger of rows that a frozen holdout excludes: key, reason, the first of the columns whose value the holdout holds."""
    out = rows
    for c in reasons:
        held = holdout.where(F.col(c).isNotNull()).select(F.col(c).alias(f"_v_{c}"), F.lit(True).alias(f"_h_{c}")).distinct()
        out = out.join(held, F.col(c) == F.col(f"_v_{c}"), "left").drop(f"_v_{c}")
    why = F.coalesce(*[F.when(F.col(f"_h_{c}"), F.lit(c)) for c in reasons])
    return out.select(key, why.alias("reason")).where("reason is not null")


def equal_sets(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Keys of one side only: key, side."""
    both = expected.select(key, F.lit(True).alias("_e")).distinct().join(given.select(key, F.lit(True).alias("_g")).distinct(), key, "full")
    return both.where("_e is null or _g is null").select(key, F.when(F.col("_e").isNull(), "unexpected").otherwise("missing").alias("side"))


def empty_on_error(rows: DataFrame, key: str, status: str, payload: str) -> DataFrame:
    """Rows that failed but hold a payload, or are fine but hold none."""
    has = F.coalesce(F.trim(payload), F.lit("")) != ""
    return violations(holds(rows.where(F.col(status) != "ok"), "payload_on_error", key, ~has), holds(rows.where(F.col(status) == "ok"), "no_payload", key, has))


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str, column: str) -> DataFrame:
    """All keys of the fallback with the primary's value where it has one, and from where it comes."""
    j = fallback.select(key, F.col(column).alias("_f")).join(primary.select(key, F.col(column).alias("_p")), key, "left")
    return j.select(key, F.coalesce("_p", "_f").alias(column), F.when(F.col("_p").isNotNull(), "primary").otherwise("fallback").alias("origin"))


def prefix_subset(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in a frozen total order; none for n = 0."""
    return rows.orderBy(*order).limit(n)


def text_lengths(rows: DataFrame, page: str, text: str) -> DataFrame:
    """Characters of each page, its lines joined by one sign."""
    return rows.groupBy(page).agg((F.sum(F.char_length(F.coalesce(F.col(text), F.lit("")))) + F.count(F.lit(1)) - 1).alias("chars"))


def partition_report(rows: DataFrame, flag: Column, measures: dict[str, Column]) -> DataFrame:
    """All rows and, beside them, the biased part where the flag holds, named as such."""
    parts = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.coalesce(flag, F.lit(False)), F.lit("biased_subset")))))
    return rows.withColumn("part", parts).groupBy("part").agg(*[c.alias(n) for n, c in measures.items()])


def variant_summary(rows: DataFrame, by: str, conflict: Column, page: str) -> DataFrame:
    """Per variant: pages, pages with a conflict, and the share of these."""
    each = rows.groupBy(by, page).agg(F.bool_or(F.coalesce(conflict, F.lit(False))).alias("c"))
    return each.groupBy(by).agg(F.count(F.lit(1)).alias("pages"), F.count_if("c").alias("conflicts"), F.avg(F.col("c").cast("double")).alias("share"))
