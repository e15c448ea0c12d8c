"""Scoring of predictions against references: references drive, a missing or failed prediction is an empty hypothesis."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atrament.functions import values
from atrament.functions.text import normalize_v1
from atrament.functions.trees import errors_of, word_edits


def scored_join(reference: DataFrame, predictions: DataFrame, key: str, text: str, payload: str) -> DataFrame:
    """reference left-joined to predictions (key, status, payload): adds ok and hypothesis. Both texts are normalized."""
    p = predictions.select(key, (F.col("status") == "ok").alias("ok"), normalize_v1(F.col(payload)).alias("hypothesis"))
    out = reference.join(p, key, "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    return out.withColumn("hypothesis", F.when(F.col("ok"), F.coalesce("hypothesis", F.lit(""))).otherwise("")).withColumn(text, F.coalesce(normalize_v1(F.col(text)), F.lit("")))


def with_edits(pairs: DataFrame, text: str = "reference", hypothesis: str = "hypothesis", word_level: bool = True) -> DataFrame:
    """Adds char_edits, chars and, if asked, word_edits and words."""
    out = pairs.withColumn("char_edits", F.levenshtein(text, hypothesis).cast("bigint")).withColumn("chars", F.char_length(text).cast("bigint"))
    if word_level:
        out = out.withColumn("word_edits", word_edits(text, hypothesis).cast("bigint")).withColumn("words", F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")).cast("bigint"))
    return out


def error_rates(scored: DataFrame, by: list[list[str]]) -> DataFrame:
    """Micro rates of several groupings at once; a grouping's absent columns are null. Edits and lengths are summed as
    integers and divided once; a rate over no characters is null."""
    cols = sorted({c for g in by for c in g})
    sums = [F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("ok")).alias("failed"), F.sum("char_edits").alias("char_edits"), F.sum("chars").alias("chars")]
    if "words" in scored.columns:
        sums += [F.sum("word_edits").alias("word_edits"), F.sum("words").alias("words")]
    out = scored.groupingSets([[F.col(c) for c in g] for g in by], *[F.col(c) for c in cols]).agg(*sums)
    out = out.withColumn("cer", F.col("char_edits") / F.nullif("chars", F.lit(0)))
    return out.withColumn("wer", F.col("word_edits") / F.nullif("words", F.lit(0))) if "words" in scored.columns else out


def domain_summary(scored: DataFrame, domain: str, text: str = "hypothesis") -> DataFrame:
    """Micro rates, lines and replacement characters of each domain and of all together (``combined``)."""
    both = scored.withColumn("_d", F.explode(F.array(F.col(domain), F.lit("combined")))).drop(domain).withColumnRenamed("_d", domain)
    got = both.groupBy(domain).agg(F.count(F.lit(1)).alias("lines"), *[F.sum(c).alias(c) for c in ("char_edits", "chars", "word_edits", "words")], F.sum(F.regexp_count(text, F.lit("\ufffd"))).cast("bigint").alias("replacement_characters"))
    rate = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return got.select(domain, "lines", rate("char_edits", "chars").alias("cer"), rate("word_edits", "words").alias("wer"), "replacement_characters")


def subset_rates(scored: DataFrame, subsets: dict[str, Column]) -> DataFrame:
    """Micro rates of named, possibly overlapping subsets in one pass."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in subsets.items()]))
    return error_rates(scored.withColumn("subset", F.explode(names)), [["subset"]])


def protected_selection(summaries: DataFrame, baseline: str, gain: str, guard: str) -> DataFrame:
    """summaries (name, domain, cer, wer, lines, replacement_characters) to (name, reasons, chosen). A candidate must lower the
    character rate of the domain ``gain`` and of all, raise neither rate of the domain ``guard``, and add no replacement
    character anywhere; the eligible one of the least (combined rate, name) is chosen, else the baseline."""
    base = summaries.where(F.col("name") == baseline).select("domain", *[F.col(c).alias(f"b_{c}") for c in ("cer", "wer", "lines", "replacement_characters")])
    j = summaries.where(F.col("name") != baseline).join(F.broadcast(base), "domain", "full")  # a row per domain
    why = F.when(F.col("lines").isNull() | F.col("b_lines").isNull() | (F.col("lines") != F.col("b_lines")), F.array(F.lit("other_lines"))).otherwise(
        F.array_compact(
            F.array(
                F.when(F.col("replacement_characters") > F.col("b_replacement_characters"), F.lit("replacement_characters")),
                F.when(F.col("domain").isin(gain, "combined") & (F.col("cer") >= F.col("b_cer") - 1e-12), F.lit("cer_not_improved")),
                F.when((F.col("domain") == guard) & (F.col("cer") > F.col("b_cer") + 1e-12), F.lit("cer_regression")),
                F.when((F.col("domain") == guard) & (F.col("wer") > F.col("b_wer") + 1e-12), F.lit("wer_regression")),
            )
        )
    )
    each = j.where("name is not null").select("name", F.when(F.col("domain") == "combined", F.col("cer")).alias("cer"), F.transform(why, lambda x: F.concat_ws(":", "domain", x)).alias("why"))
    out = each.groupBy("name").agg(F.max("cer").alias("cer"), F.array_sort(F.flatten(F.collect_list("why"))).alias("reasons"))
    best = out.agg(F.min_by("name", F.when(F.size("reasons") == 0, F.struct("cer", "name"))).alias("best"))
    return out.join(F.broadcast(best)).select("name", F.array_join("reasons", ",").alias("reasons"), F.coalesce(F.col("name") == F.col("best"), F.lit(False)).alias("chosen"))  # one row


def macro(scored: DataFrame, score: str, by: list[str]) -> DataFrame:
    return scored.groupBy(*by).agg(F.avg(score).alias(score), F.count(F.lit(1)).alias("rows"))


def field_verdicts(fields: DataFrame) -> DataFrame:
    """fields (key.., kind, reference, predicted) with the verdict of the normalized values."""
    r, p = values.field_value(F.col("reference"), F.col("kind")), values.field_value(F.col("predicted"), F.col("kind"))
    return fields.withColumn("verdict", values.verdict(r, p))


def field_f1(verdicts: DataFrame, by: list[list[str]]) -> DataFrame:
    """Micro precision, recall and F1 of groupings; absent fields do not count, nothing at all is perfect."""
    cols = sorted({c for g in by for c in g})
    n = lambda *v: F.count_if(F.col("verdict").isin(*v)).cast("bigint")
    got = verdicts.where("verdict <> 'absent'").groupingSets([[F.col(c) for c in g] for g in by], *[F.col(c) for c in cols]).agg(n("match").alias("tp"), n("mismatch", "spurious").alias("fp"), n("mismatch", "missing").alias("fn"))
    rate = lambda a, b: F.when(F.col("tp") + a + b == 0, 1.0).otherwise(F.col("tp") / F.greatest(F.col("tp") + a + b, F.lit(1)))
    return got.withColumn("precision", rate(F.col("fp"), F.lit(0))).withColumn("recall", rate(F.col("fn"), F.lit(0))).withColumn("f1", F.when(F.col("tp") + F.col("fp") + F.col("fn") == 0, 1.0).otherwise(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))))


def composite(scores: dict[str, float | None]) -> float | None:
    """The mean over the given parts of 1 - cer, teds and f1, not clipped."""
    parts = [1 - v if k == "cer" else v for k, v in scores.items() if v is not None]
    return sum(parts) / len(parts) if parts else None


def error_profile(pairs: DataFrame, text: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """Counts of differing character pairs by kind over minimal alignments."""
    e = pairs.select(F.explode(errors_of(text, hypothesis)).alias("e")).select("e.*")
    return e.groupBy("op", "kind", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def glyph_inventory(df: DataFrame, text: str) -> DataFrame:
    """Counts of the characters beyond ASCII."""
    c = df.select(F.explode(F.split(F.regexp_replace(text, r"[\x00-\x7f]", ""), "")).alias("glyph")).where("glyph <> ''")
    return c.groupBy("glyph").agg(F.count(F.lit(1)).alias("n"))


def paired(a: DataFrame, b: DataFrame, key: str, metric: str) -> DataFrame:
    """Both runs' metric per key with the change; keys of one run only raise."""
    both = a.select(key, F.col(metric).alias("a")).join(b.select(key, F.col(metric).alias("b")), key, "full")
    return both.withColumn("delta", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("b") - F.col("a")).otherwise(F.raise_error(F.concat(F.lit("unpaired key "), F.col(key).cast("string")))))


def change_counts(pairs: DataFrame, by: list[str], eps: float = 1e-12) -> DataFrame:
    d = F.col("delta")
    return pairs.groupBy(*by).agg(F.count_if(d < -eps).alias("improved"), F.count_if(d > eps).alias("regressed"), F.count_if(F.abs(d) <= eps).alias("tied"), F.sum("delta").alias("net"))


PRIME = 2147483647


def poisson_weights(keys: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """How often each key is in each draw: Poisson(1) by the inverse of its distribution at a hash of both."""
    x = (keys[:, None] % PRIME * 48271 + draws[None, :] * 69621 + 12345) % PRIME
    y = (x * x + x) % PRIME
    u = (y * 16807 + x) % PRIME / PRIME
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
    return np.searchsorted(steps[:-1], u, side="right")


def bootstrap(pairs: DataFrame, draws: int = 20_000, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """pairs (key bigint, a, b, chars) to the change of the micro rate, sum(b - a) / sum(chars), its percentile interval and
    the share of draws in which b is better. Instead of picking rows, each row has a Poisson(1) weight per draw from a hash of
    (key, draw): no row moves; each partition sums up its rows for all draws and sends one row per draw."""

    def sums(batches):
        change, size = np.zeros(draws), np.zeros(draws)
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.iloc[i : i + 256]
                w = poisson_weights(part["key"].to_numpy(np.int64), np.arange(draws, dtype=np.int64))
                change += (part["b"] - part["a"]).to_numpy(float) @ w
                size += part["chars"].to_numpy(float) @ w
        yield pd.DataFrame({"draw": np.arange(draws), "change": change, "size": size})

    rows = pairs.select("key", "a", "b", "chars").where("key is not null")
    means = rows.mapInPandas(sums, "draw bigint, change double, size double").groupBy("draw").agg((F.sum("change") / F.nullif(F.sum("size"), F.lit(0.0))).alias("mean"))
    got = means.agg(F.array_sort(F.collect_list("mean")).alias("m"))  # draws values
    seen = rows.agg((F.sum(F.col("b") - F.col("a")) / F.nullif(F.sum("chars"), F.lit(0))).alias("change"))
    return got.join(F.broadcast(seen)).select("change", values.index_percentile(F.col("m"), low).alias("low"), values.index_percentile(F.col("m"), high).alias("high"), (F.size(F.filter("m", lambda x: x < 0)) / F.size("m")).alias("share_better"))  # a row each


def best_candidate(rows: DataFrame, eligible: Column, score: str, name: str, baseline: str) -> DataFrame:
    """The eligible candidate of the least (score, name), else the baseline."""
    return rows.agg(F.coalesce(F.min_by(name, F.when(eligible, F.struct(score, name))), F.lit(baseline)).alias("chosen"))


def promotion(rows: DataFrame, slices: list[str], tolerance: dict[str, float]) -> DataFrame:
    """Candidates (name, slice columns of changes): each slice's verdict and whether all pass."""
    checks = {f"{s}_ok": F.coalesce(F.col(s) <= tolerance.get(s, 0.0) + 1e-12, F.lit(False)) for s in slices}
    out = rows.withColumns(checks)
    return out.withColumn("promoted", F.forall(F.array(*checks), lambda x: x))


def timing(df: DataFrame, seconds: str, by: list[str]) -> DataFrame:
    s = F.when(F.col(seconds) >= 0, F.col(seconds))
    return df.groupBy(*by).agg(F.count(s).alias("timed"), F.avg(s).alias("mean"), F.max(s).alias("max"), F.sum(s).alias("total"))


def running_best(df: DataFrame, by: list[str], order: str, score: str) -> DataFrame:
    """Marks rows that are strictly better than all before; the first wins ties."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("best_so_far", F.coalesce(F.col(score) < F.min(score).over(before), F.lit(True)))
