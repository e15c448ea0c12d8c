"""Corpus preparation: unions with lineage, quotas that interact, firewalls, label routing, synthetic records."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atrament.functions.values import NIP_WEIGHTS, check_digit, money_text
from atrament.session import Scratch, numbered


def root_id() -> Column:
    """The line a record descends from: its parent, else what it supersedes, else itself."""
    return F.coalesce("parent_id", "superseded_id", "id")


def merge_pools(parts: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """The union of packages with their names; of rows of one root the one of the latest package in ``order`` stays."""
    rank = F.create_map(*[F.lit(x) for i, n in enumerate(order) for x in (n, i)])
    out = None
    for name, df in parts.items():
        x = df.withColumn("package", F.lit(name))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    for c in ("parent_id", "superseded_id"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    out = out.withColumn("root_id", root_id())
    return out.groupBy("root_id").agg(F.max_by(F.struct(*[c for c in out.columns if c != "root_id"]), F.element_at(rank, F.col("package"))).alias("r")).select("root_id", "r.*")


def firewall(train: DataFrame, held: DataFrame, columns: list[str]) -> DataFrame:
    """Values of the columns that both sides hold: column, value. Must be empty."""
    out = None
    for c in columns:
        x = train.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("value")).join(held.select(F.col(c).cast("string").alias("value")), "value", "left_semi").distinct().select(F.lit(c).alias("column"), "value")
        out = x if out is None else out.union(x)
    return out


def split_reasons(pages: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Pairs of pages of different splits with why they belong together: equal image, text, document, edition or family,
    or a near text from ``near`` (a, b). One equi-join per reason, none over all pairs."""
    reasons = {"image": "image_sha256", "text": "text_sha256", "document": "document_id", "edition": "edition_id", "family": "work_family"}
    x, out = pages.alias("x"), None
    for name, c in reasons.items():
        if c in pages.columns:
            p = x.join(pages.alias("y"), (F.col(f"x.{c}") == F.col(f"y.{c}")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.split") != F.col("y.split"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit(name).alias("reason"))
            out = p if out is None else out.union(p)
    if near is not None:
        out = near.select("a", "b", F.lit("near").alias("reason")) if out is None else out.union(near.select("a", "b", F.lit("near").alias("reason")))
    return out.groupBy("a", "b").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def _first(rows: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first rows of each group with their place; cut within hash parts first, so that a hot group is not ordered whole."""
    out = rows.withColumn("_part", F.pmod(F.xxhash64("_h"), F.lit(64)))
    out = out.withColumn("place", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))).where(F.col("place") <= most)
    return out.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= most).drop("_part")


def capped_quota(rows: DataFrame, group: str, page: str, priority: str, rank: Column, per_page: int, per_group: int) -> DataFrame:
    """At most ``per_group`` rows of a group and ``per_page`` of a page, by falling priority, then rank. Page caps are
    applied first: a page belongs to one group, so the greedy order and the two windows choose the same rows."""
    out = rows.withColumn("_h", rank)
    out = out.withColumn("_p", F.row_number().over(Window.partitionBy(group, page).orderBy(F.desc(priority), "_h"))).where(F.col("_p") <= per_page)
    return _first(out, group, [F.desc(priority), F.col("_h")], per_group).drop("_h", "_p")


def pages_in_turn(rows: DataFrame, group: str, page: str, rank: Column, per_group: int) -> DataFrame:
    """Of each group ``per_group`` rows, one of each page in turn."""
    out = rows.withColumn("_h", rank).withColumn("_r", F.row_number().over(Window.partitionBy(group, page).orderBy("_h")))
    return _first(out, group, [F.col("_r"), F.col("_h")], per_group).drop("_h", "_r")


def route_labels(detections: DataFrame, names: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Detections with canonical labels, and those whose label has no name here."""
    key = F.trim(F.regexp_replace(F.lower("label"), r"[\s_-]+", " "))
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)
    out = detections.withColumn("canonical", known)
    return out.where("canonical is not null"), out.where("canonical is null").drop("canonical")


def big_enough(boxes: DataFrame, box: str, height: int, width: int) -> DataFrame:
    at = lambda i: F.get(box, F.lit(i))
    return boxes.where((at(3) - at(1) >= height) & (at(2) - at(0) >= width))


def backend(lines: Column, page_height: Column, few: int = 4, tall: int = 1500) -> Column:
    """The recognizer for a page: few lines on a tall page mean that the line detector failed."""
    return F.when((lines < few) & (page_height >= tall), "whole_page").otherwise("lines")


def healthy(status: Column, text: Column, finish: Column) -> Column:
    return F.coalesce((status == "ok") & (F.trim(text) != "") & (finish != "length"), F.lit(False))


def holdout_value(*columns: Column) -> Column:
    """The first given of a row's, its sample's and its recipe's value."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def review_queue(pages: DataFrame, search: str | None = None, state: str | None = None) -> DataFrame:
    """Pages whose id or text holds the search, in a state: flagged, pending or reviewed."""
    out = pages
    if search:
        out = out.where(F.lower("id").contains(search.lower()) | F.lower("text").contains(search.lower()))
    rule = {"flagged": "size(flags) > 0", "pending": "decision is null", "reviewed": "decision is not null"}
    return out.where(rule[state]) if state else out


def accept_correction(raw: Column, corrected: Column) -> Column:
    """A correction that keeps the number of lines, else the raw text."""
    lines = lambda c: F.size(F.split(F.trim(c), "\n"))
    return F.when(corrected.isNotNull() & (F.trim(corrected) != "") & (lines(raw) == lines(corrected)), corrected).otherwise(raw)


def mean_probability(tokens: Column, probabilities: Column, special: list[int]) -> Column:
    """The mean probability of the chosen tokens without special ones; null if none is left."""
    kept = F.filter(F.arrays_zip(tokens.alias("t"), probabilities.alias("p")), lambda x: ~x["t"].isin(special))
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x["p"]) / F.size(kept))


def later_wins(parts: list[DataFrame], key: str, text: str) -> DataFrame:
    """One text per key: that of the last part that has one."""
    out = None
    for i, df in enumerate(parts):
        x = df.select(key, F.col(text).alias("text"), F.lit(i).alias("_i"))
        out = x if out is None else out.union(x)
    return out.groupBy(key).agg(F.max_by("text", F.when(F.col("text").isNotNull(), F.col("_i"))).alias(text))


def positional(a: DataFrame, b: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """Rows of both sides paired by their position in a total order; sides of different length raise."""
    number = lambda df, s: numbered(df, [F.col(c) for c in order], "position", scratch).select(F.struct(*df.columns).alias(s), "position")
    j = number(a, "a").join(number(b, "b"), "position", "full")
    return j.withColumn("a", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("a")).otherwise(F.raise_error(F.lit("sides differ in length")).cast(j.schema["a"].dataType)))


def agreement(source: DataFrame, first: DataFrame, second: DataFrame, key: str, text: str) -> DataFrame:
    """How two systems agree with each other and with the source text, per key."""
    j = source.select(key, F.col(text).alias("s")).join(first.select(key, F.col(text).alias("x")), key, "left").join(second.select(key, F.col(text).alias("y")), key, "left")
    state = F.when(F.col("x").isNull() | F.col("y").isNull(), "missing").when((F.col("x") == F.col("y")) & (F.col("x") == F.col("s")), "all").when(F.col("x") == F.col("y"), "systems").when((F.col("x") == F.col("s")) | (F.col("y") == F.col("s")), "one").otherwise("none")
    return j.withColumn("agreement", state)


def copies(rows: DataFrame, k: int) -> DataFrame:
    """k numbered copies of each row with a seed of its own."""
    out = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return out.withColumn("seed", F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.col("copy").cast("string")), 256), 1, 8), 16, 10).cast("bigint"))


def page_of_stem(stem: Column) -> Column:
    return F.regexp_replace(stem, r"_[^_]*$", "")


def html_table(rows: Column) -> Column:
    """An array of rows of cells as an HTML table with escaped texts."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), esc(c), F.lit("</td>"))), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(rows, row), ""), F.lit("</table>"))


def synthetic_invoices(spark: SparkSession, count: int, seed: str) -> DataFrame:
    """Invented invoices (id, text, fields); every value is drawn from a hash of seed, number and field, so any row can be made alone."""
    draw = lambda what, n: F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"), F.lit(what)), 256), 1, 8), 16, 10).cast("bigint") % n
    nine = F.lpad(draw("nip", 900_000_000).cast("string"), 9, "1")
    base = spark.range(count).select("id", draw("no", 999).alias("no"), (draw("y", 6) + 2019).alias("year"), nine.alias("nine"), F.date_add(F.lit("2019-01-01").cast("date"), draw("d", 2000).cast("int")).cast("string").alias("issue_date"), (draw("sum", 999_999) / 100).alias("total"))
    digit = check_digit(F.col("nine"), NIP_WEIGHTS, "nip")
    out = base.withColumn("nip", F.concat("nine", F.coalesce(digit, F.lit(0)).cast("string"))).withColumn("number", F.concat_ws("/", F.lit("FV"), "no", "year"))
    text = F.concat(F.lit("Faktura nr "), "number", F.lit(", NIP "), "nip", F.lit(", data "), "issue_date", F.lit(", razem "), money_text(F.col("total")))
    fields = F.create_map(F.lit("invoice_number"), F.col("number"), F.lit("seller_nip"), F.col("nip"), F.lit("issue_date"), F.col("issue_date"), F.lit("total"), F.format_string("%.2f", "total"))
    return out.select(F.col("id").cast("string").alias("id"), text.alias("text"), fields.alias("fields"))


def disjoint_subset(groups: list[tuple[str, int, frozenset]], pages: int, classes: frozenset) -> tuple[str, ...]:
    """Of a few groups (name, pages, classes) the subset whose pages are nearest to the target and that holds all classes,
    then the smallest, then the first by name; every subset is tried, so at most 20 groups are allowed."""
    if len(groups) > 20:
        raise ValueError("too many groups for a full search")
    best = None
    for n in range(1, len(groups)):
        for chosen in combinations(sorted(groups), n):
            seen = frozenset().union(*(g[2] for g in chosen))
            rank = (len(classes - seen), abs(sum(g[1] for g in chosen) - pages), n, tuple(g[0] for g in chosen))
            best = rank if best is None or rank < best else best
    return best[3] if best else ()


def recompute_audit(reported: DataFrame, recomputed: DataFrame, keys: list[str], metrics: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Reported metrics that differ from recomputed ones by more than the tolerance, or stand on one side only."""
    j = reported.select(*keys, *[F.col(m).alias(f"r_{m}") for m in metrics], F.lit(True).alias("_r")).join(recomputed.select(*keys, *[F.col(m).alias(f"c_{m}") for m in metrics], F.lit(True).alias("_c")), keys, "full")
    bad = F.col("_r").isNull() | F.col("_c").isNull()
    for m in metrics:
        bad |= F.coalesce(F.abs(F.col(f"r_{m}") - F.col(f"c_{m}")) > tolerance, ~F.col(f"r_{m}").eqNullSafe(F.col(f"c_{m}")))
    return j.where(bad).drop("_r", "_c")


def trim_advice(pixels: pd.Series, edge: int = 3) -> list[tuple[int, int]]:
    """Rows to cut at the top and bottom of grey crops: traces of neighbours that end within ``edge`` rows of an inkless one."""
    import numpy as np

    out = []
    for p in pixels:
        g = np.stack([np.asarray(r) for r in p])
        ink = (g < g.mean() - g.std() * 0.5).any(1)
        cut = []
        for side in (ink, ink[::-1]):
            free = np.flatnonzero(~side)
            cut.append(int(free[0]) if len(free) and 0 < free[0] <= edge and side[0] else 0)
        out.append(tuple(cut))
    return out
