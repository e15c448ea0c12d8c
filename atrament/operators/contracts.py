"""Integrity contracts. Each check gives rows (rule, key, detail); a gate raises on the first of them, before any write."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rows(df: DataFrame, rule: str, key: Column, detail: Column | None = None) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def unique_key(df: DataFrame, key: str) -> DataFrame:
    """Keys that are null or occur more than once."""
    got = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull())
    return _rows(got, "unique_key", F.col(key), F.col("n"))


def exact_columns(df: DataFrame, allowed: set[str]) -> list[str]:
    """Columns that are missing or must not be there, as in inputs that may hold no reference text."""
    return sorted(set(df.columns) ^ set(allowed))


def in_domain(df: DataFrame, key: str, column: str, values: list) -> DataFrame:
    return _rows(df.where(~F.coalesce(F.col(column).isin(values), F.lit(False))), f"domain:{column}", F.col(key), F.col(column))


def finite(df: DataFrame, key: str, column: str, least: float = 0.0) -> DataFrame:
    c = F.col(column).cast("double")
    return _rows(df.where(c.isNotNull() & (F.isnan(c) | (c < least) | (c == float("inf")))), f"finite:{column}", F.col(key), F.col(column))


def matches(df: DataFrame, key: str, column: str, pattern: str) -> DataFrame:
    return _rows(df.where(~F.coalesce(F.col(column).rlike(pattern), F.lit(False))), f"format:{column}", F.col(key), F.col(column))


def missing(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    return _rows(expected.join(given, key, "left_anti"), "missing", F.col(key))


def unknown(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    return _rows(given.join(expected, key, "left_anti"), "unknown", F.col(key))


def holds(df: DataFrame, rule: str, key: str, condition: Column) -> DataFrame:
    """Rows where the condition is false or null."""
    return _rows(df.where(~F.coalesce(condition, F.lit(False))), rule, F.col(key))


def violations(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, checks)


def gate(*checks: DataFrame) -> None:
    found = violations(*checks).limit(5).collect()
    if found:
        raise ValueError("contract broken: " + "; ".join(f"{r.rule} {r.key} {r.detail or ''}".strip() for r in found))


def submission(reference: DataFrame, predictions: DataFrame, payload: str) -> DataFrame:
    """What is wrong with a set of predictions: ids, statuses, payloads of errors, times."""
    return violations(
        unique_key(predictions, "id"), missing(reference.select("id"), predictions.select("id"), "id"), unknown(reference.select("id"), predictions.select("id"), "id"),
        in_domain(predictions, "id", "status", ["ok", "error"]), holds(predictions.where("status = 'error'"), "error_payload", "id", F.coalesce(F.col(payload), F.lit("")) == ""), finite(predictions, "id", "elapsed_seconds"),
    )


def checksum_audit(listed: DataFrame, actual: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """Full outer join of listed and actual checksums: key, listed, actual, state (ok, changed, missing, unlisted)."""
    both = listed.select(key, F.col(digest).alias("listed")).join(actual.select(key, F.col(digest).alias("actual")), key, "full")
    state = F.when(F.col("actual").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("listed") == F.col("actual"), "ok").otherwise("changed")
    return both.withColumn("state", state)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equality as multisets."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def safe_path(col: Column) -> Column:
    """A relative path that stays below its root."""
    return F.coalesce((col != "") & ~col.rlike(r"^(?:[/\\]|[A-Za-z]:)|(?:^|[/\\])\.\.(?:[/\\]|$)|[\x00]"), F.lit(False))


def trace_ok(tokens: Column, limit: Column, reached: Column, finish: Column) -> Column:
    """A generation trace that agrees with its flags."""
    return (F.size(tokens) <= limit) & (reached == (F.size(tokens) == limit)) & ((finish == "length") == reached)
