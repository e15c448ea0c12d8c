"""Problem 5: consensus from several annotators' labels.

Method: a community confusion model, inferred by variational updates. Each annotator belongs softly to one of
COMMUNITIES types with a shared confusion matrix; an annotator's own matrix has its types' mean as prior, worth
STRENGTH labels per row, so that few labels of its own leave it near its type. The updates alternate over spots
(posterior of each candidate label), annotators, types and class shares. Spots with the same answers are one weighted
pattern; only candidates that someone answered are kept, so a round is a join on (annotator, truth, answer) and two
aggregations, whatever the number of spots.

Defined cases: null, blank, ``<empty>`` or an answer of wrapping only is no answer; a spot without answers has no row in
the consensus; rows of one spot_id that occur again count once (the latest, then the greatest); a null spot_id is
ignored; ties go to the label first in code point order; empty tables give no rows, and annotators without answers a
null reliability.
"""

from __future__ import annotations

import math
import unicodedata
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atrament.session import Scratch, lookup, table

ANNOTATORS = ["tesseract_js", "gpt_4o_mini", "qwen3_vl_4b", "paddlevl_1_6", "qwen3_vl_235b_api", "gpt_5_4"]
COMMUNITIES, ROUNDS, STRENGTH = 3, 8, 50.0
#: Pseudo-counts of a type's confusion matrix, right and wrong; what a wrong label gets is shared by all labels.
RIGHT, WRONG = 40.0, 10.0
#: The first posterior is this power of the share of votes: a label that is only ever a rare slip must not found a class of its own.
SHARPEN = 6

_WRAP = regex.compile(r"^[\s\p{Z}\p{C}\p{Pi}\p{Pf}\p{Ps}\p{Pe}\"'`´*<>＂＇]+|[\s\p{Z}\p{C}\p{Pi}\p{Pf}\p{Ps}\p{Pe}\"'`´*<>＂＇]+$")


def clean(answer: str | None) -> str | None:
    """The label of an answer, without its wrapping; None if there is none."""
    if answer is None:
        return None
    got = _WRAP.sub("", unicodedata.normalize("NFC", answer))
    if not got or got == "empty" and "<empty>" in answer:
        return None
    return got


def labels(evidence: DataFrame, annotators: list[str]) -> DataFrame:
    """One row per spot: spot_id and said, the cleaned answers in the order of annotators."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "said": [[clean(x) for x in row] for row in b["raw"]]})

    once = evidence.where("spot_id is not null").groupBy("spot_id").agg(F.max(F.struct("collected_at", F.array(*annotators).alias("raw")))["raw"].alias("raw"))
    once = once.withColumn("key", F.to_json("raw"))  # one pattern may hold a third of all spots
    pure = once.groupBy("key").agg(F.first("raw").alias("raw")).mapInPandas(run, "key string, said array<string>")
    return lookup(once.select("spot_id", "key"), pure, "key", "inner").select("spot_id", "said").where("exists(said, x -> x is not null)")


def digamma(x: Column) -> Column:
    y = x + 6
    return F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * y * y * y * y) - reduce(lambda a, b: a + b, [1 / (x + i) for i in range(6)])


def _softmax(score: str, keys: list[str]) -> Column:
    w = Window.partitionBy(*keys)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return e / F.sum(e).over(w)


def infer(patterns: DataFrame, names: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame, dict]:
    """patterns (pid, said, w) to the posterior (pid, truth, q), the expected counts (k, truth, answer, n) and the annotators' types."""
    said = F.posexplode("said").alias("k", "answer")
    given = patterns.select("pid", "w", said).where("answer is not null")
    truth = patterns.select("pid", F.explode(F.array_distinct(F.filter("said", lambda x: x.isNotNull()))).alias("truth"))
    cells = scratch.keep(truth.join(given, "pid"))
    size = given.agg(F.countDistinct("answer").alias("v")).first()["v"]
    off = WRONG / max(1, size)
    votes = cells.groupBy("pid", "truth").agg(F.count_if(F.col("truth") == F.col("answer")).alias("v"))
    post = scratch.keep(votes.select("pid", "truth", (F.pow("v", F.lit(SHARPEN)) / F.sum(F.pow("v", F.lit(SHARPEN))).over(Window.partitionBy("pid"))).alias("q")))
    share = {k: {m: (0.5 if m == k % COMMUNITIES else 0.5 / max(1, COMMUNITIES - 1)) for m in range(COMMUNITIES)} for k in range(len(names))}
    counts = None
    for step in range(ROUNDS):
        counts = scratch.keep(cells.join(post, ["pid", "truth"]).groupBy("k", "truth", "answer").agg(F.sum(F.col("w") * F.col("q")).alias("n")))
        # types: expected counts of all annotators by their share in the type
        weight = lambda m: F.element_at(F.create_map(*[F.lit(x) for k in share for x in (k, share[k][m])]), F.col("k"))  # noqa: E731, B023
        prior = F.when(F.col("truth") == F.col("answer"), RIGHT + off).otherwise(off)
        types = counts.groupBy("truth", "answer").agg(*[F.sum(F.col("n") * weight(m)).alias(f"s{m}") for m in range(COMMUNITIES)])
        row = Window.partitionBy("truth")
        types = types.select("truth", "answer", *[(prior + F.col(f"s{m}")).alias(f"a{m}") for m in range(COMMUNITIES)], *[(F.sum(f"s{m}").over(row) + RIGHT + WRONG).alias(f"t{m}") for m in range(COMMUNITIES)])
        types = scratch.keep(types.withColumn("cell", F.concat_ws("\x00", "truth", "answer")).drop("truth", "answer"))
        seen = lookup(counts.withColumn("cell", F.concat_ws("\x00", "truth", "answer")), types, "cell")
        fits = seen.groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * (digamma(F.col(f"a{m}")) - digamma(F.col(f"t{m}")))).alias(f"f{m}") for m in range(COMMUNITIES)]).collect()  # a row per annotator
        held = [sum(share[k][m] for k in share) + 1 for m in range(COMMUNITIES)]
        for r in fits:
            x = [math.log(held[m]) + r[f"f{m}"] for m in range(COMMUNITIES)]
            e = [math.exp(v - max(x)) for v in x]
            share[r.k] = {m: e[m] / sum(e) for m in range(COMMUNITIES)}
        mean = reduce(lambda a, b: a + b, [weight(m) * F.col(f"a{m}") / F.col(f"t{m}") for m in range(COMMUNITIES)])
        own = Window.partitionBy("k", "truth")
        odds = seen.select(F.concat_ws("\x00", "k", "truth", "answer").alias("cell"), (digamma(STRENGTH * mean + F.col("n")) - digamma(STRENGTH + F.sum("n").over(own))).alias("lp"))
        prior_of = post.join(patterns.select("pid", "w"), "pid").groupBy("truth").agg(F.sum(F.col("q") * F.col("w")).alias("c"))
        total = prior_of.agg(F.sum("c").alias("c")).first()["c"] or 0
        prior_of = prior_of.select("truth", F.log((F.col("c") + 1) / (total + size)).alias("lc"))
        scored = lookup(cells.withColumn("cell", F.concat_ws("\x00", "k", "truth", "answer")), scratch.keep(odds), "cell").groupBy("pid", "truth").agg(F.sum("lp").alias("s"))
        scored = lookup(scored, scratch.keep(prior_of), "truth").withColumn("s", F.col("s") + F.col("lc"))
        post = scratch.keep(scored.select("pid", "truth", _softmax("s", ["pid"]).alias("q")))
    return post, counts, share


def consensus(evidence: DataFrame, annotators: list[str], scratch: Scratch):
    """(spots, annotators): spot_id, label, confidence, agreement (share of its answers that equal the label), answers; and
    annotator, answers, reliability (expected share of right answers), community."""
    spots = scratch.keep(labels(evidence, annotators).withColumn("pid", F.to_json("said")))  # a hash would skip the nulls that tell patterns apart
    patterns = scratch.keep(spots.groupBy("said").agg(F.first("pid").alias("pid"), F.count(F.lit(1)).alias("w")))
    post, counts, share = infer(patterns, annotators, scratch)
    best = post.groupBy("pid").agg(F.max(F.struct("q", "truth")).alias("top"), F.max("q").alias("m"), F.collect_list(F.struct("q", "truth")).alias("all"))  # at most one entry per annotator
    best = best.select("pid", F.array_min(F.transform(F.filter("all", lambda x: x.q >= F.col("m") - 1e-9), lambda x: x.truth)).alias("label"), F.col("m").alias("confidence"))
    out = patterns.join(best, "pid").select("pid", "said", "label", "confidence")
    answers = F.size(F.filter("said", lambda x: x.isNotNull()))
    out = out.withColumn("answers", answers).withColumn("agreement", F.size(F.filter("said", lambda x: x == F.col("label"))) / F.col("answers"))
    found = lookup(spots.select("spot_id", "pid"), scratch.keep(out.drop("said")), "pid", "inner").select("spot_id", "label", "confidence", "agreement", "answers")
    own = counts.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("answer"), F.col("n")).otherwise(0)).alias("right"))
    names = scratch.spark.createDataFrame([(k, a, max(share[k], key=lambda m: (share[k][m], -m))) for k, a in enumerate(annotators)], "k int, annotator string, community int")
    people = names.join(own, "k", "left").select("annotator", F.round("n").cast("long").alias("answers"), ((F.col("right") + STRENGTH * RIGHT / (RIGHT + WRONG)) / (F.col("n") + STRENGTH)).alias("reliability"), "community")
    return found, people


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus(table(spark, sf_dir, "uffd_evidence"), ANNOTATORS, Scratch(spark, "consensus"))[0].select("spot_id", "label")


def p5_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus(table(spark, sf_dir, "uffd_evidence"), ANNOTATORS, Scratch(spark, "consensus"))[0]


def p5_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus(table(spark, sf_dir, "uffd_evidence"), ANNOTATORS, Scratch(spark, "consensus"))[1]


def p5_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Krippendorff's nominal alpha over all spots with at least two answers."""
    scratch = Scratch(spark, "consensus")
    rows = labels(table(spark, sf_dir, "uffd_evidence"), ANNOTATORS)
    rows = scratch.keep(rows.withColumn("n", F.size(F.filter("said", lambda x: x.isNotNull()))).where("n >= 2").groupBy("said", "n").agg(F.count(F.lit(1)).alias("w")))
    each = rows.select("said", "n", "w", F.explode("said").alias("v")).where("v is not null").groupBy("said", "n", "w", "v").agg(F.count(F.lit(1)).alias("c"))
    agree = each.agg(F.sum(F.col("w") * F.col("c") * (F.col("c") - 1) / (F.col("n") - 1)).alias("same"), F.sum(F.col("w") * F.col("c")).alias("t"))
    marg = each.groupBy("v").agg(F.sum(F.col("w") * F.col("c")).alias("m")).agg(F.sum(F.col("m") * (F.col("m") - 1)).alias("mm"))
    spots = rows.agg(F.sum("w").alias("spots"))
    one = agree.withColumn("j", F.lit(1)).join(marg.withColumn("j", F.lit(1)), "j").join(spots.withColumn("j", F.lit(1)), "j")  # a row each
    observed, expected = 1 - F.col("same") / F.col("t"), 1 - F.col("mm") / (F.col("t") * (F.col("t") - 1))
    return one.select(F.coalesce("spots", F.lit(0)).alias("spots"), F.coalesce("t", F.lit(0)).alias("answers"), (1 - observed / expected).alias("alpha"))


QUERIES = {"p5_found": p5_found, "p5_consensus": p5_consensus, "p5_annotators": p5_annotators, "p5_agreement": p5_agreement}
