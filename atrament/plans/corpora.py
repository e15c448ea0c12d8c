"""Corpus preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrament.functions.fold import current_records, split_name
from atrament.operators import corpus, select
from atrament.plans.registry import CURRENT, query, split_sql
from atrament.session import table


@query("capped_quota", f"""WITH {CURRENT}, r AS (SELECT id, page_id, collection, length(coalesce(reference, '')) AS p, sha256('q' || chr(0) || id) AS h FROM cur WHERE collection IS NOT NULL), a AS (SELECT *, row_number() OVER (PARTITION BY collection, page_id ORDER BY p DESC, h) AS k FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY p DESC, h) AS place FROM a WHERE k <= 2) SELECT collection, id, place FROM b WHERE place <= 10""")
def capped_quota(spark, d):
    rows = current_records(table(spark, d, "printed_replay_geometry"), ["page_id", "collection", "reference"]).where("collection is not null").withColumn("p", F.char_length(F.coalesce("reference", F.lit(""))))
    return corpus.capped_quota(rows, "collection", "page_id", "p", select.hash_rank("q", "id"), 2, 10).select("collection", "id", "place")


@query("pages_in_turn", f"""WITH {CURRENT}, r AS (SELECT id, page_id, collection, sha256('t' || chr(0) || id) AS h FROM cur WHERE collection IS NOT NULL), a AS (SELECT *, row_number() OVER (PARTITION BY collection, page_id ORDER BY h) AS k FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY k, h) AS place FROM a) SELECT collection, id, place FROM b WHERE place <= 6""")
def pages_in_turn(spark, d):
    rows = current_records(table(spark, d, "printed_replay_geometry"), ["page_id", "collection"]).where("collection is not null")
    return corpus.pages_in_turn(rows, "collection", "page_id", select.hash_rank("t", "id"), 6).select("collection", "id", "place")


@query("train_firewall", f"""WITH {CURRENT}, r AS (SELECT page_id, image_sha256, {split_sql("split")} AS s FROM cur), t AS (SELECT * FROM r WHERE s = 'train'), h AS (SELECT * FROM r WHERE s <> 'train')
SELECT 'page_id' AS "column", page_id AS value FROM (SELECT DISTINCT page_id FROM t WHERE page_id IN (SELECT page_id FROM h)) UNION ALL SELECT 'image_sha256', image_sha256 FROM (SELECT DISTINCT image_sha256 FROM t WHERE image_sha256 IN (SELECT image_sha256 FROM h))""")
def train_firewall(spark, d):
    r = current_records(table(spark, d, "printed_replay_geometry"), ["page_id", "image_sha256", "split"]).withColumn("s", split_name(F.col("split")))
    return corpus.firewall(r.where("s = 'train'"), r.where("s <> 'train'"), ["page_id", "image_sha256"])


@query("system_agreement", """WITH u AS (SELECT DISTINCT spot_id, gpt_5_4 AS s, qwen3_vl_4b AS x, qwen3_vl_235b_api AS y FROM uffd_evidence)
SELECT CASE WHEN x IS NULL OR y IS NULL THEN 'missing' WHEN x = y AND x = s THEN 'all' WHEN x = y THEN 'systems' WHEN x = s OR y = s THEN 'one' ELSE 'none' END AS agreement, count(*) AS n FROM u GROUP BY 1""")
def system_agreement(spark, d):
    u = table(spark, d, "uffd_evidence").select("spot_id", "gpt_5_4", "qwen3_vl_4b", "qwen3_vl_235b_api").distinct()
    side = lambda c: u.select("spot_id", F.col(c).alias("t"))
    return corpus.agreement(side("gpt_5_4"), side("qwen3_vl_4b"), side("qwen3_vl_235b_api"), "spot_id", "t").groupBy("agreement").agg(F.count(F.lit(1)).alias("n"))


@query("later_text_wins", f"""WITH {CURRENT}, a AS (SELECT id, text AS t FROM cur), b AS (SELECT id, reference AS t FROM cur WHERE min_word_confidence < 80) SELECT id, coalesce(b.t, a.t) AS t FROM a LEFT JOIN b USING (id)""")
def later_text_wins(spark, d):
    r = current_records(table(spark, d, "printed_replay_geometry"), ["text", "reference", "min_word_confidence"])
    return corpus.later_wins([r.select("id", F.col("text").alias("t")), r.where("min_word_confidence < 80").select("id", F.col("reference").alias("t"))], "id", "t")


@query("accepted_corrections", """WITH r AS (SELECT DISTINCT response_id, input, output FROM responses WHERE category = 'repair_synthetic' AND input IS NOT NULL)
SELECT response_id, CASE WHEN output IS NOT NULL AND trim(output) <> '' AND len(string_split(trim(input), chr(10))) = len(string_split(trim(output), chr(10))) THEN output ELSE input END AS text FROM r""")
def accepted_corrections(spark, d):
    r = table(spark, d, "responses").where("category = 'repair_synthetic' and input is not null").select("response_id", "input", "output").distinct()
    return r.select("response_id", corpus.accept_correction(F.col("input"), F.col("output")).alias("text"))


@query("healthy_answers", """SELECT category, count(*) AS n, count(*) FILTER (coalesce(status = 'ok' AND trim(output) <> '' AND finish_reason <> 'length', false)) AS healthy FROM (SELECT DISTINCT response_id, category, status, output, finish_reason FROM responses) GROUP BY category""")
def healthy_answers(spark, d):
    r = table(spark, d, "responses").select("response_id", "category", "status", "output", "finish_reason").distinct()
    return r.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(corpus.healthy(F.col("status"), F.col("output"), F.col("finish_reason"))).alias("healthy"))


@query("synthetic_invoices")
def synthetic_invoices(spark, d):
    return corpus.synthetic_invoices(spark, 500, "s").select("id", "text", F.to_json("fields").alias("fields"))
