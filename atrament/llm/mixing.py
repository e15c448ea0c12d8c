"""Problem 7: mixing sources to target weights.

Method: iterative proportional fitting. Token totals of the cells (source, language, topic) are raked to three margins:
the mix's source shares, and the pool's language and topic shares; the source margin comes last, so it holds exactly.
A cell's factor is the expected number of uses of each of its texts, capped at max_repeats, what is cut going to the
source's other cells. Texts are then drawn by systematic sampling along their calibrated factors: in order of size,
hashed within a size, the running sum of factors, kept in millionths as integers, crosses a whole number as often as the text is used.

The size of a mix, unless given, is the largest at which every source with texts can reach its share: the least of
tokens * max_repeats / share. A larger size leaves such sources short; the report shows shares reached and missed.

Defined cases: equal texts under several ids are one text, that of the least doc_id; null and empty texts, and sources
in no mix, are left out; a source without texts gets nothing; null languages and topics form a class of their own;
repeated target rows count once; empty tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atrament.llm.languages import language
from atrament.llm.tokens import TOKENIZER, with_sizes
from atrament.session import Scratch, running_total, table

ROUNDS, UNIT = 60, 1_000_000
#: Cells are classes of source, language and topic; more than this is an error, not a reason to drop some.
MOST_CELLS = 1_000_000


def rake(cells: dict[tuple, int], share: dict[str, float], cap: dict[str, int], size: float | None = None) -> tuple[dict[tuple, float], float]:
    """cells (source, language, topic) -> tokens; gives the factor of each cell and the size of the mix."""
    have: dict = defaultdict(float)
    for (s, _, _), t in cells.items():
        have[s] += t
    reach = {s: have[s] * cap[s] / share[s] for s in share if share[s] > 0 and have[s] > 0}
    if not reach:
        return {}, 0.0
    size = min(reach.values()) if size is None else size
    pool = sum(t for c, t in cells.items() if c[0] in reach)
    w = {c: float(t) for c, t in cells.items() if c[0] in reach and t > 0}
    goals = [defaultdict(float), defaultdict(float), defaultdict(float)]
    for c, t in w.items():
        goals[1][c[1]] += t / pool * size
        goals[2][c[2]] += t / pool * size
    goals[0].update({s: share[s] * size for s in reach})
    for _ in range(ROUNDS):
        for axis in (1, 2, 0):
            now: dict = defaultdict(float)
            for c, x in w.items():
                now[c[axis]] += x
            for c in w:
                w[c] *= goals[axis][c[axis]] / now[c[axis]]
    factor = {}
    for s in reach:
        own = {c: x / cells[c] for c, x in w.items() if c[0] == s}
        goal = min(goals[0][s], have[s] * cap[s])
        fixed: dict[tuple, float] = {}
        while True:  # each pass fixes at least one cell at the cap
            open_ = {c: f for c, f in own.items() if c not in fixed}
            rest = goal - sum(f * cells[c] for c, f in fixed.items())
            now = sum(f * cells[c] for c, f in open_.items())
            k = rest / now if now else 0.0
            over = [c for c, f in open_.items() if f * k > cap[s]]
            if not over:
                factor |= fixed | {c: f * k for c, f in open_.items()}
                break
            fixed |= dict.fromkeys(over, float(cap[s]))
    return factor, size


def pool(spark: SparkSession, sf_dir: str, scratch: Scratch, tokenizer: str) -> DataFrame:
    """One row per doc with a text and its size; text is replaced by its hash, which two texts share by chance only once in 2^128."""
    docs = table(spark, sf_dir, "documents").where("text is not null and text <> '' and source is not null")
    docs = docs.select("doc_id", "source", language(F.col("lang")).alias("language"), F.coalesce("doc_kind", F.lit("none")).alias("topic"), "text")
    return scratch.keep(with_sizes(docs, path=tokenizer).select("doc_id", "source", "language", "topic", F.md5(F.col("text").cast("binary")).alias("text"), "n_tokens"))


def mix(docs: DataFrame, targets: dict[str, tuple[float, int]], scratch: Scratch, size: float | None = None) -> DataFrame:
    """docs (doc_id, source, language, topic, text, n_tokens) and source -> (share, max_repeats) to the texts used: doc_id, source, language, topic, n_tokens, uses."""
    spark = scratch.spark
    one = docs.where(F.col("source").isin(*targets)).groupBy("text").agg(F.min(F.struct("doc_id", "source", "language", "topic", "n_tokens")).alias("d")).select("d.*")
    one = scratch.keep(one)
    cells = one.groupBy("source", "language", "topic").agg(F.sum("n_tokens").alias("t")).limit(MOST_CELLS + 1).collect()
    if len(cells) > MOST_CELLS:
        raise ValueError("too many classes of source, language and topic")
    share, cap = {s: x[0] for s, x in targets.items()}, {s: x[1] for s, x in targets.items()}
    factor, _ = rake({(r.source, r.language, r.topic): r.t for r in cells}, share, cap, size)
    units = spark.createDataFrame([(*c, min(int(f * UNIT), cap[c[0]] * UNIT)) for c, f in factor.items()], "source string, language string, topic string, f bigint")
    rows = one.join(F.broadcast(units) if len(factor) < 100_000 else units, ["source", "language", "topic"])
    order = [F.col("source"), F.col("n_tokens"), F.xxhash64("doc_id", F.lit(11)), F.col("doc_id")]
    rows = running_total(rows, order, "f", "before", scratch)
    uses = F.expr(f"((before + f + {UNIT // 2}) div {UNIT}) - ((before + {UNIT // 2}) div {UNIT})")
    return rows.withColumn("uses", uses.cast("int")).where("uses > 0").select("doc_id", "source", "language", "topic", "n_tokens", "uses")


def mixes(spark: SparkSession, sf_dir: str) -> dict[str, dict[str, tuple[float, int]]]:
    out: dict = defaultdict(dict)
    for r in table(spark, sf_dir, "mix_targets").where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).orderBy("mix_id", "source").collect():  # a fixed few
        out[r.mix_id][r.source] = (float(r.share or 0), int(r.cap if r.cap is not None else 1))
    return out


def selected(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER, size: float | None = None) -> DataFrame:
    scratch = Scratch(spark, "mixing")
    docs, out = pool(spark, sf_dir, scratch, tokenizer), None
    for name, targets in mixes(spark, sf_dir).items():
        got = mix(docs, targets, scratch, size).select(F.lit(name).alias("mix_id"), "*")
        out = got if out is None else out.union(got)
    return out if out is not None else spark.createDataFrame([], "mix_id string, doc_id bigint, source string, language string, topic string, n_tokens bigint, uses int")


def p7_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected(spark, sf_dir).drop("language", "topic")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mix and source: the target, the tokens used, and the share reached."""
    from pyspark.sql import Window

    got = selected(spark, sf_dir).groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("texts"), F.max("uses").alias("most_uses"))
    goal = table(spark, sf_dir, "mix_targets").where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    out = goal.join(got, ["mix_id", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    share = F.col("tokens") / F.sum("tokens").over(Window.partitionBy("mix_id"))
    return out.select("mix_id", "source", "target_share", "max_repeats", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "tokens", share.alias("actual_share"))


def p7_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mix and class of each margin (source, language, topic): the target share, the tokens used and the share reached.
    Languages and topics aim at their shares of the pool; caps, and the source margin, which comes last, keep them from it."""
    from pyspark.sql import Window

    axes = ("source", "language", "topic")
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("class")) for a in axes]))
    used = selected(spark, sf_dir).select("mix_id", each.alias("m"), (F.col("n_tokens") * F.col("uses")).alias("t")).groupBy("mix_id", "m.axis", "m.class").agg(F.sum("t").alias("tokens"))
    goal = table(spark, sf_dir, "mix_targets").where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(F.max("target_share").alias("s"))
    docs = pool(spark, sf_dir, Scratch(spark, "mixing"), TOKENIZER).groupBy("text").agg(F.min(F.struct("doc_id", *axes, "n_tokens")).alias("d")).select("d.*")
    cells = docs.groupBy(*axes).agg(F.sum("n_tokens").alias("t")).join(goal.select("mix_id", "source"), "source")
    have = cells.select("mix_id", each.alias("m"), "t").where("m.axis <> 'source'").groupBy("mix_id", "m.axis", "m.class").agg(F.sum("t").alias("s"))
    want = have.union(goal.select("mix_id", F.lit("source"), "source", "s"))
    share = lambda c: F.col(c) / F.sum(c).over(Window.partitionBy("mix_id", "axis"))
    out = want.join(used, ["mix_id", "axis", "class"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return out.select("mix_id", "axis", "class", share("s").alias("target_share"), "tokens", share("tokens").alias("actual_share"))


def p7_broken_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mix: its sources, and the texts used more often than their source allows."""
    goal = table(spark, sf_dir, "mix_targets").where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(F.max("max_repeats").alias("cap"))
    got = goal.join(selected(spark, sf_dir).select("mix_id", "source", "uses"), ["mix_id", "source"], "left").groupBy("mix_id")
    return got.agg(F.count_distinct("source").alias("sources"), F.count_if(F.col("uses") > F.col("cap")).alias("broken"))


SQL = {"p7_broken_caps": "SELECT mix_id, count(DISTINCT source) AS sources, 0 AS broken FROM mix_targets GROUP BY mix_id"}
QUERIES = {"p7_selected": p7_selected, "p7_shares": p7_shares, "p7_margins": p7_margins, "p7_broken_caps": p7_broken_caps}
