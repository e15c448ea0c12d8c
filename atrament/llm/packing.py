"""Problem 6: filling containers of fixed capacity with items, with as little unused space as possible.

Method: length-histogram planning. Best fit, longest first, runs over the counts of each length instead of over
documents, so its work depends on the capacity only. A plan row says which ranks of a length go to which containers.
Documents get their rank within their length from range partitions and take the planned slot by a join on (length, rank).

An item above the capacity is cut into pieces of the capacity and a rest; no other item is cut. A separator between two
neighbours counts as in pack_specs. Defined cases: null and empty texts have no tokens and are in no container; repeated
texts and repeated rows of a doc_id are items of their own; a null doc_id is kept; specs without a positive capacity are
ignored; empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atrament.llm.tokens import TOKENIZER, with_sizes
from atrament.session import Scratch, running_total, table

PLAN = "n_tokens bigint, first bigint, last bigint, container bigint, each bigint, position bigint"


def plan(counts: dict[int, int], capacity: int, separator: int) -> list[tuple]:
    """Rows of PLAN: items of n_tokens with ranks first..last-1 go, ``each`` per container, to the containers from
    ``container`` on, at positions from ``position`` on. Lengths are at most the capacity."""
    room: dict[int, list] = {}  # free space, separator included -> ranges (first container, containers, items in each)
    free: list[int] = []  # the keys of room, ascending
    rows, used = [], 0

    def add(space: int, run: tuple) -> None:
        if space not in room:
            room[space] = []
            insort(free, space)
        room[space].append(run)

    for n in sorted(counts, reverse=True):
        need, left, rank = n + separator, counts[n], 0
        while left:
            i = bisect_left(free, need)
            if i < len(free):
                space = free[i]
                start, many, items = room[space].pop()
                if not room[space]:
                    del room[space], free[i]
            else:
                space, items = capacity + separator, 0
                start, many = used, -(-left // (space // need))
                used += many
            each = space // need
            full = min(many, left // each)
            if full:
                rows.append((n, rank, rank + full * each, start, each, items))
                add(space - each * need, (start, full, items + each))
            rank, left, start, many = rank + full * each, left - full * each, start + full, many - full
            if left and many:
                rows.append((n, rank, rank + left, start, left, items))
                add(space - left * need, (start, 1, items + left))
                rank, left, start, many = rank + left, 0, start + 1, many - 1
            if many:
                add(space, (start, many, items))
    return rows


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """sizes (doc_id, n_tokens) to (doc_id, piece, start_token, n_tokens), none above the capacity."""
    cut = sizes.where("n_tokens > 0").select("doc_id", F.col("n_tokens").alias("all"), F.explode(F.sequence(F.lit(0), F.expr(f"(n_tokens - 1) div {capacity}"))).alias("piece"))
    start = F.col("piece") * F.lit(capacity)
    return cut.select("doc_id", "piece", start.alias("start_token"), F.least(F.lit(capacity), F.col("all") - start).cast("bigint").alias("n_tokens"))


def pack(sizes: DataFrame, capacity: int, separator: int, scratch: Scratch) -> DataFrame:
    """sizes (doc_id, n_tokens) to (container, position, doc_id, piece, start_token, n_tokens)."""
    spark = scratch.spark
    items = pieces(sizes, capacity)
    counts = {r.n_tokens: r.n for r in items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    rows = plan(counts, capacity, separator)
    before, at = {}, 0
    for n in sorted(counts):
        before[n], at = at, at + counts[n]
    order = [F.col("n_tokens"), F.xxhash64("doc_id", "piece"), F.col("doc_id"), F.col("piece")]
    ranked = running_total(items.withColumn("one", F.lit(1)), order, "one", "rank", scratch).drop("one")
    starts = spark.createDataFrame(list(before.items()), "n_tokens bigint, before bigint")
    slots = spark.createDataFrame(rows, PLAN).withColumnRenamed("n_tokens", "n")
    ranked = ranked.join(F.broadcast(starts), "n_tokens").withColumn("rank", F.col("rank") - F.col("before"))
    slots = slots if len(rows) > 500_000 else F.broadcast(slots)
    took = ranked.join(slots, (F.col("n_tokens") == F.col("n")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    k = F.col("rank") - F.col("first")
    return took.select(
        (F.col("container") + F.expr("(rank - first) div each") + 1).alias("container"), (F.col("position") + k % F.col("each")).cast("int").alias("position"), "doc_id", F.col("piece").cast("int").alias("piece"), "start_token", "n_tokens"
    )


def packed(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    scratch = Scratch(spark, "packing")
    sizes = scratch.keep(with_sizes(table(spark, sf_dir, "documents").select("doc_id", "text"), path=tokenizer).where("n_tokens > 0").select("doc_id", "n_tokens"))
    specs = table(spark, sf_dir, "pack_specs").where("capacity_tokens > 0").select("spec_id", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("separator_tokens")).distinct().orderBy("spec_id").collect()  # a fixed few
    out = None
    for s in specs:
        got = pack(sizes, s.capacity_tokens, s.separator_tokens, scratch).select(F.lit(s.spec_id).alias("spec_id"), "*")
        out = got if out is None else out.union(got)
    if out is None:
        out = spark.createDataFrame([], "spec_id int, container bigint, position int, doc_id bigint, piece int, start_token bigint, n_tokens bigint")
    return out


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir)


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per spec: items, tokens, containers, the least number of containers any packing needs, and the share of used space."""
    each = packed(spark, sf_dir).groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    got = each.groupBy("spec_id").agg(F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("containers"))
    out = got.join(table(spark, sf_dir, "pack_specs").select("spec_id", "capacity_tokens", "separator_tokens").distinct(), "spec_id")
    least = F.ceil((F.col("tokens") + F.col("items") * F.col("separator_tokens")) / (F.col("capacity_tokens") + F.col("separator_tokens")))
    return out.select("spec_id", "items", "tokens", "containers", least.alias("least_containers"), (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))


def p6_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per spec: documents packed, containers above the capacity, and documents cut without need."""
    specs = table(spark, sf_dir, "pack_specs").where("capacity_tokens > 0").select("spec_id", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("separator")).distinct()
    got = packed(spark, sf_dir)
    full = got.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k")).join(F.broadcast(specs), "spec_id").groupBy("spec_id").agg(F.count_if(F.expr("t + (k - 1) * separator > capacity_tokens")).alias("overfull"))
    docs = got.groupBy("spec_id", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k")).join(F.broadcast(specs), "spec_id").groupBy("spec_id").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.expr("k > 1 and t <= capacity_tokens")).alias("cut"))
    return docs.join(full, "spec_id").select("spec_id", "docs", "overfull", "cut")


SQL = {"p6_whole": "SELECT spec_id, (SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '') AS docs, 0 AS overfull, 0 AS cut FROM (SELECT DISTINCT spec_id FROM pack_specs WHERE capacity_tokens > 0)"}
QUERIES = {"p6_packed": p6_packed, "p6_report": p6_report, "p6_whole": p6_whole}
