"""Leakage between splits: equal keys, near texts by shingles, near hashes by Hamming distance. Exact joins, no loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_keys(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that several splits hold: key, splits, rows."""
    got = rows.where(F.col(key).isNotNull() & F.col(split).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits"), F.count(F.lit(1)).alias("rows"))
    return got.where(F.size("splits") > 1)


def prefix_pairs(rows: DataFrame, key: str, tokens: str, threshold: float) -> DataFrame:
    """Pairs (a, b, common, jaccard), a < b, of rows whose distinct tokens have a Jaccard similarity of the threshold or more.

    Prefix filter: with tokens ordered from rare to common, two such sets share one of their first
    size - ceil(threshold * size) + 1 tokens, so only those are joined; sizes must be near as well. Rows of equal sets
    should be collapsed before: they are one class.
    """
    items = rows.select(key, F.array_distinct(tokens).alias("t")).where(F.size("t") > 0)
    freq = items.select(F.explode("t").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("f"))
    ranked = items.select(key, F.size("t").alias("n"), F.explode("t").alias("w")).join(freq, "w").groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("o"))
    head = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    heads = ranked.select(key, "n", F.explode(F.slice("o", F.lit(1), head.cast("int"))).alias("x")).select(key, "n", F.col("x.w").alias("w"))
    a, b = (heads.select("w", F.col(key).alias(s), F.col("n").alias(f"n_{s}")) for s in "ab")
    near = (F.col("a") < F.col("b")) & (F.col("n_a") >= threshold * F.col("n_b") - 1e-9) & (F.col("n_b") >= threshold * F.col("n_a") - 1e-9)
    cand = a.join(b, "w").where(near).select("a", "b").distinct()
    sets = [items.select(F.col(key).alias(s), F.col("t").alias(f"t_{s}")) for s in "ab"]
    out = cand.join(sets[0], "a").join(sets[1], "b").withColumn("common", F.size(F.array_intersect("t_a", "t_b")))
    out = out.withColumn("jaccard", F.col("common") / (F.size("t_a") + F.size("t_b") - F.col("common")))
    return out.where(F.col("jaccard") >= threshold - 1e-9).select("a", "b", "common", "jaccard")


def contained_pairs(left: DataFrame, right: DataFrame, tokens: str, threshold: float) -> DataFrame:
    """left (a, tokens), right (b, tokens) to the pairs a <> b (a, b, common, jaccard, containment) of which the smaller set is
    in the other to the threshold or more; the Jaccard similarity reaches it only then.

    Of the smaller set's tokens, ordered from rare to common, one of the first size - ceil(threshold * size) + 1 is in the
    other. So these meet all tokens of the other side, both ways; a token that more than half of a side holds is rarely among them."""
    x, y = left.select("a", F.array_distinct(tokens).alias("t")).where(F.size("t") > 0), right.select("b", F.array_distinct(tokens).alias("t")).where(F.size("t") > 0)
    freq = x.select(F.explode("t").alias("w")).union(y.select(F.explode("t").alias("w"))).groupBy("w").agg(F.count(F.lit(1)).alias("f"))

    def heads(df: DataFrame, key: str) -> DataFrame:
        ranked = df.select(key, F.size("t").alias("n"), F.explode("t").alias("w")).join(freq, "w").groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("o"))
        head = (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).cast("int")
        return ranked.select(key, "n", F.explode(F.slice("o", F.lit(1), head)).alias("x")).select(key, "n", F.col("x.w").alias("w"))

    full = lambda df, key: df.select(key, F.size("t").alias("m"), F.explode("t").alias("w"))
    cand = heads(x, "a").join(full(y, "b"), "w").where("n <= m and a <> b").select("a", "b").union(heads(y, "b").join(full(x, "a"), "w").where("n <= m and a <> b").select("a", "b")).distinct()
    out = cand.join(x.withColumnRenamed("t", "t_a"), "a").join(y.withColumnRenamed("t", "t_b"), "b").withColumn("common", F.size(F.array_intersect("t_a", "t_b")))
    out = out.withColumn("jaccard", F.col("common") / (F.size("t_a") + F.size("t_b") - F.col("common"))).withColumn("containment", F.col("common") / F.least(F.size("t_a"), F.size("t_b")))
    return out.where(F.col("containment") >= threshold - 1e-9).select("a", "b", "common", "jaccard", "containment")


def hamming_pairs(left: DataFrame, right: DataFrame, bits: str, radius: int) -> DataFrame:
    """left (a, bits), right (b, bits) to (a, b, distance) within the radius of 64-bit hashes. Of radius div 2 + 1 chunks of the
    bits one differs in at most one bit: the left side gives each chunk with each single bit turned, the right side as it is.
    Few wide chunks make keys rare: for a radius of 6 a pair of unrelated hashes meets with probability 0.001. Equal
    hashes should be collapsed before: they are one class."""
    chunks = radius // 2 + 1
    cut = [64 * i // chunks for i in range(chunks + 1)]
    chunk = lambda i: F.shiftrightunsigned(F.shiftleft(bits, 64 - cut[i + 1]), 64 - cut[i + 1] + cut[i])
    key = lambda i, v: F.struct(F.lit(i).alias("chunk"), v.alias("v"))
    turned = [key(i, chunk(i).bitwiseXOR(F.lit(m).cast("bigint"))) for i in range(chunks) for m in (0, *(1 << k for k in range(cut[i + 1] - cut[i])))]
    x = left.select("a", F.col(bits).alias("bits_a"), F.explode(F.array(*turned)).alias("k")).select("a", "bits_a", "k.*")
    y = right.select("b", F.col(bits).alias("bits_b"), F.explode(F.array(*[key(i, chunk(i)) for i in range(chunks)])).alias("k")).select("b", "bits_b", "k.*")
    got = x.join(y, ["chunk", "v"]).withColumn("distance", F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))))
    return got.where(F.col("distance") <= radius).select("a", "b", "distance").distinct()


def disjoint_values(rows: DataFrame, value: str, split: str, train: str = "train") -> DataFrame:
    """Per value: whether it stands in train and elsewhere, with the other splits."""
    got = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.bool_or(F.col(split) == train).alias("in_train"), F.array_sort(F.collect_set(F.when(F.col(split) != train, F.col(split)))).alias("others"))
    return got.where(F.col("in_train") & (F.size("others") > 0))
