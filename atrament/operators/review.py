"""Review logs: chains of events, latest decisions, adjudication between reviewers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atrament.functions.text import collapse, first_reason


def chain_breaks(events: DataFrame, page: str, order: list[str], original: str = "original") -> DataFrame:
    """Events whose text before is not the text after of the event before (the original for the first), or whose time goes back."""
    w = Window.partitionBy(page).orderBy(*order)
    out = events.withColumn("expected", F.coalesce(F.lag("after").over(w), F.col(original))).withColumn("backward", F.coalesce(F.col("timestamp") < F.lag("timestamp").over(w), F.lit(False)))
    return out.where(~F.col("before").eqNullSafe(F.col("expected")) | F.col("backward"))


def latest(events: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """The latest event per key, with whether different ones share its time."""
    got = events.groupBy(*keys, time).agg(F.max(F.struct(*columns)).alias("r"), (F.countDistinct(F.struct(*columns)) > 1).alias("ambiguous"))
    return got.groupBy(*keys).agg(F.max_by(F.struct("r", "ambiguous"), time).alias("x"), F.max(time).alias(time)).select(*keys, time, "x.r.*", "x.ambiguous")


def adjudicate(decisions: DataFrame, page: str = "page_id", least: int = 2) -> DataFrame:
    """decisions (page, reviewer, after, decision, ambiguous) to a state per page: verified by enough reviewers with one
    text, in conflict over texts or ambiguous, else pending."""
    d = decisions.withColumn("who", F.lower(collapse(F.col("reviewer"))))
    got = d.groupBy(page).agg(F.countDistinct("after").alias("texts"), F.countDistinct(F.when(F.col("decision") == "verified", F.col("who"))).alias("verified"), F.countDistinct("who").alias("reviewers"), F.bool_or("ambiguous").alias("ambiguous"), F.min("after").alias("text"))
    state = F.when(F.col("ambiguous") | (F.col("texts") > 1), "conflict").when((F.col("verified") >= least) & (F.col("verified") == F.col("reviewers")), "verified").otherwise("pending")
    return got.withColumn("state", state).withColumn("text", F.when(F.col("state") == "verified", F.col("text")))


def import_status(lines: DataFrame, events: DataFrame) -> DataFrame:
    """Lines with their latest event: the first status that holds."""
    last = events.groupBy("id").agg(F.max_by(F.struct("decision", "geometry_decision", "after"), "timestamp").alias("e")).select("id", "e.*")
    j = lines.join(last, "id", "left")
    status = first_reason(
        (F.col("decision").isNull(), "unreviewed"), (F.col("geometry_decision") == "rejected", "rejected-crop"), (F.col("decision") != "verified", "pending"), (F.col("geometry_decision") == "conflict", "geometry-conflict"),
        (F.coalesce(F.trim("after"), F.lit("")) == "", "text-quality-quarantine"), (F.lit(True), "candidate"),
    )
    return j.withColumn("status", status)


def draft_text(note, after, text):
    """A note that stands for a transcription, else the reviewed text, else the source."""
    return F.coalesce(F.nullif(F.trim(note), F.lit("")), after, text)


def edit_diff(before: DataFrame, after: DataFrame, key: str, label: str, box: str, tolerance: float = 1.0) -> DataFrame:
    """Full outer comparison of annotations: added, deleted, relabeled, moved or kept."""
    j = before.select(key, F.col(label).alias("l0"), F.col(box).alias("b0")).join(after.select(key, F.col(label).alias("l1"), F.col(box).alias("b1")), key, "full")
    far = F.exists(F.zip_with("b0", "b1", lambda x, y: F.abs(x - y)), lambda d: d > tolerance)
    return j.withColumn("change", F.when(F.col("l0").isNull() & F.col("b0").isNull(), "added").when(F.col("l1").isNull() & F.col("b1").isNull(), "deleted").when(F.col("l0") != F.col("l1"), "relabeled").when(far, "moved").otherwise("kept"))
