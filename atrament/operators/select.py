"""Deterministic selection: ranks by salted hashes, quotas, round robin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_rank(salt: str, key: str) -> Column:
    """The SHA-256 of salt, NUL and key: a fixed random order."""
    return F.sha2(F.concat(F.lit(salt + "\x00"), F.col(key).cast("string")), 256)


def per_group(df: DataFrame, group: str, rank: Column, most: int) -> DataFrame:
    """At most ``most`` rows of each group, by rank. Rows are cut within hash parts first, so that a hot group is never
    ordered whole in one task."""
    parts = df.withColumn("_h", rank).withColumn("_p", F.pmod(F.xxhash64("_h"), F.lit(64)))
    first = parts.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_p").orderBy("_h"))).where(F.col("_r") <= most)
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_h"))).where(F.col("_r") <= most).drop("_h", "_p").withColumnRenamed("_r", "rank")


def round_robin(df: DataFrame, group: str, salt: str, key: str, total: int) -> DataFrame:
    """``total`` rows, one of each group in turn; groups and rows in hashed order."""
    got = per_group(df, group, hash_rank(salt, key), total)
    return got.withColumn("_g", F.sha2(F.concat(F.lit(salt + "\x00"), F.col(group).cast("string")), 256)).orderBy("rank", "_g").limit(total).drop("_g")


def first_of_groups(df: DataFrame, group: str, salt: str, key: str, groups: int) -> DataFrame:
    """The first row of each of ``groups`` groups, both by hash."""
    one = df.groupBy(group).agg(F.min_by(key, hash_rank(salt, key)).alias(key))
    return one.orderBy(F.sha2(F.concat(F.lit(salt + "\x00"), F.col(group).cast("string")), 256), group).limit(groups)


def distinct_until(df: DataFrame, text: str, first: Column, total: int) -> DataFrame:
    """Distinct texts, those where ``first`` holds before the others, by hash, until the total."""
    return df.where(F.col(text).isNotNull()).groupBy(text).agg(F.bool_or(first).alias("first")).orderBy(F.desc("first"), F.sha2(text, 256), text).limit(total)
