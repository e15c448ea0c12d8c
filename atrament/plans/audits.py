"""Audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrament.functions import values
from atrament.functions.fold import current_records, split_name
from atrament.functions.text import normalize_v1, shingles, words
from atrament.operators import audit, contracts, graph, scoring, similarity
from atrament.plans.registry import CURRENT, distance_sql, normal_sql, query, split_sql
from atrament.plans.scores import ANSWERS, answers
from atrament.session import Scratch, table


def records(spark, d, *cols):
    return current_records(table(spark, d, "printed_replay_geometry"), list(cols))


@query("split_summary", f"WITH {CURRENT}, r AS (SELECT {split_sql('split')} AS split, eligible_for_training AS eligible, page_id FROM cur) SELECT split, eligible, count(*) AS rows, count(DISTINCT page_id) AS pages FROM r GROUP BY GROUPING SETS ((), (split), (split, eligible))")
def split_summary(spark, d):
    r = records(spark, d, "split", "eligible_for_training", "page_id").select(split_name(F.col("split")).alias("split"), F.col("eligible_for_training").alias("eligible"), "page_id")
    return audit.split_summary(r, [[], ["split"], ["split", "eligible"]], "page_id")


@query("reference_impact", f"""WITH r AS (SELECT DISTINCT response_id, requested_model AS system, {normal_sql("reference")} AS a, {normal_sql("input")} AS b, {normal_sql("output")} AS h FROM responses WHERE category = 'preserve_clean' AND reference IS NOT NULL AND input IS NOT NULL AND output IS NOT NULL),
e AS (SELECT system, a <> b AS c, {distance_sql("a", "h")} AS x, {distance_sql("b", "h")} AS y FROM r) SELECT system, count(*) AS rows, count(*) FILTER (c) AS changed, CAST(sum(x) AS BIGINT) AS frozen_edits, CAST(sum(y) AS BIGINT) AS candidate_edits, CAST(sum(y) - sum(x) AS BIGINT) AS net FROM e GROUP BY system""")
def reference_impact(spark, d):
    r = table(spark, d, "responses").where("category = 'preserve_clean' and reference is not null and input is not null and output is not null").select("response_id", F.col("requested_model").alias("system"), "reference", "input", "output").distinct()
    r = r.select("system", *[normalize_v1(F.col(c)).alias(c) for c in ("reference", "input", "output")])
    return audit.score_impact(r, "system", "reference", "input", "output")


@query("worst_answers", ANSWERS + " SELECT category, rank, response_id, e AS edits FROM (SELECT category, response_id, e, CAST(row_number() OVER (PARTITION BY category ORDER BY e DESC, response_id) AS INT) AS rank FROM p) WHERE rank <= 5")
def worst_answers(spark, d):
    s = scoring.with_edits(answers(spark, d), word_level=False)
    return audit.worst_first(s, "category", "response_id", F.col("char_edits"), 5).select("category", "rank", "response_id", "edits")


@query("languages_by_appearance", "SELECT lang, row_number() OVER (ORDER BY f) AS place FROM (SELECT lang, min(doc_id) AS f FROM documents WHERE lang IS NOT NULL GROUP BY lang)")
def languages_by_appearance(spark, d):
    from pyspark.sql import Window

    got = audit.first_seen(table(spark, d, "documents"), "lang", ["doc_id"])  # a row per code
    return got.select("lang", F.row_number().over(Window.partitionBy().orderBy("first")).cast("bigint").alias("place"))


@query("holdout_ledger", f"""WITH {CURRENT}, r AS (SELECT id, page_id, image_sha256, collection, {split_sql("split")} AS split FROM cur), h AS (SELECT * FROM r WHERE split = 'test')
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN page_id IN (SELECT page_id FROM h WHERE page_id IS NOT NULL) THEN 'page_id' WHEN image_sha256 IN (SELECT image_sha256 FROM h WHERE image_sha256 IS NOT NULL) THEN 'image_sha256' WHEN collection IN (SELECT collection FROM h WHERE collection IS NOT NULL) THEN 'collection' END AS reason FROM r WHERE split = 'train') WHERE reason IS NOT NULL GROUP BY reason""")
def holdout_ledger(spark, d):
    r = records(spark, d, "page_id", "image_sha256", "collection", "split").withColumn("split", split_name(F.col("split")))
    got = audit.freeze_holdout(r.where("split = 'train'"), r.where("split = 'test'"), "id", ["page_id", "image_sha256", "collection"])
    return got.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("confirmation_set", """SELECT coalesce(a.page_id, b.page_id) AS page_id, CASE WHEN a.page_id IS NULL THEN 'unexpected' ELSE 'missing' END AS side FROM (SELECT DISTINCT page_id FROM printed_replay_geometry WHERE page_id IS NOT NULL) a FULL JOIN (SELECT DISTINCT page_id FROM uffd_evidence WHERE page_id IS NOT NULL) b ON a.page_id = b.page_id WHERE a.page_id IS NULL OR b.page_id IS NULL""")
def confirmation_set(spark, d):
    return audit.equal_sets(*(table(spark, d, t).select("page_id").where("page_id is not null") for t in ("printed_replay_geometry", "uffd_evidence")), "page_id")


@query("submission_check", """WITH r AS (SELECT DISTINCT response_id, status, finish_reason, output, elapsed_seconds FROM responses)
SELECT rule, count(*) AS n FROM (SELECT 'payload_on_error' AS rule FROM r WHERE status <> 'ok' AND coalesce(trim(output, ' '), '') <> '' UNION ALL SELECT 'no_payload' FROM r WHERE status = 'ok' AND coalesce(trim(output, ' '), '') = ''
UNION ALL SELECT 'domain:status' FROM r WHERE status IS NULL OR status NOT IN ('ok', 'error', 'incomplete') UNION ALL SELECT 'finite:elapsed_seconds' FROM r WHERE elapsed_seconds < 0 OR isnan(elapsed_seconds) OR isinf(elapsed_seconds)
UNION ALL SELECT 'unique_key' FROM r GROUP BY response_id HAVING count(*) > 1 OR response_id IS NULL) GROUP BY rule""")
def submission_check(spark, d):
    r = table(spark, d, "responses").select("response_id", "status", "finish_reason", "output", "elapsed_seconds").distinct()
    found = contracts.violations(audit.empty_on_error(r, "response_id", "status", "output"), contracts.in_domain(r, "response_id", "status", ["ok", "error", "incomplete"]), contracts.finite(r, "response_id", "elapsed_seconds"), contracts.unique_key(r, "response_id"))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("collections_with_fallback", f"""WITH {CURRENT}, p AS (SELECT page_id AS id, min(collection) AS c FROM cur GROUP BY 1), f AS (SELECT id, min(collection) AS c FROM page_meta GROUP BY 1) SELECT f.id, coalesce(p.c, f.c) AS collection, CASE WHEN p.c IS NOT NULL THEN 'primary' ELSE 'fallback' END AS origin FROM f LEFT JOIN p USING (id)""")
def collections_with_fallback(spark, d):
    p = records(spark, d, "page_id", "collection").groupBy("page_id").agg(F.min("collection").alias("collection")).withColumnRenamed("page_id", "id")
    f = table(spark, d, "page_meta").groupBy(F.col("id").alias("k")).agg(F.min("collection").alias("collection")).withColumnRenamed("k", "id")
    return audit.with_fallback(p, f, "id", "collection")


@query("page_text_lengths", f"WITH {CURRENT} SELECT page_id, CAST(sum(length(coalesce(reference, ''))) + count(*) - 1 AS BIGINT) AS chars FROM cur GROUP BY page_id")
def page_text_lengths(spark, d):
    return audit.text_lengths(records(spark, d, "page_id", "reference"), "page_id", "reference")


@query("replay_prefix", f"WITH {CURRENT} SELECT id FROM cur WHERE reference IS NOT NULL ORDER BY sha256(id), id LIMIT 200")
def replay_prefix(spark, d):
    r = records(spark, d, "reference").where("reference is not null").withColumn("h", F.sha2("id", 256))
    return audit.prefix_subset(r, ["h", "id"], 200).select("id")


@query("stopped_partitions", ANSWERS + ", q AS (SELECT 'all' AS part, * FROM p UNION ALL SELECT 'biased_subset', * FROM p WHERE finish_reason = 'stop') SELECT part, count(*) AS rows, CAST(sum(e) AS BIGINT) AS edits FROM q GROUP BY part")
def stopped_partitions(spark, d):
    r = table(spark, d, "responses").select("response_id", "finish_reason").distinct()
    s = scoring.with_edits(answers(spark, d), word_level=False).join(r, "response_id")
    return audit.partition_report(s, F.col("finish_reason") == "stop", {"rows": F.count(F.lit(1)), "edits": F.sum("char_edits")})


@query("variant_conflicts", f"""WITH {CURRENT}, e AS (SELECT {split_sql("split")} AS split, page_id, bool_or(coalesce(text <> reference, false)) AS c FROM cur GROUP BY 1, 2) SELECT split, count(*) AS pages, count(*) FILTER (c) AS conflicts, round(avg(CASE WHEN c THEN 1.0 ELSE 0.0 END), 9) AS share FROM e GROUP BY split""")
def variant_conflicts(spark, d):
    r = records(spark, d, "split", "page_id", "text", "reference").withColumn("split", split_name(F.col("split")))
    return audit.variant_summary(r, "split", F.expr("text <> reference"), "page_id").withColumn("share", F.round("share", 9))


_SHAPES = ["dt", "replace(dt, '-', '.')", "concat(substr(dt, 9, 2), '/', substr(dt, 6, 2), '/', substr(dt, 1, 4))", "concat(cast(cast(substr(dt, 9, 2) as int) as string), '.', cast(cast(substr(dt, 6, 2) as int) as string), '.', substr(dt, 1, 4), ' r.')"]


@query("date_shapes", """WITH r AS (SELECT DISTINCT response_id, regexp_extract(input, 'data (\\d{4}-\\d{2}-\\d{2})', 1) AS dt FROM responses WHERE category = 'extract') SELECT response_id, shape, dt AS day FROM r, (VALUES (0), (1), (2), (3), (4), (5)) AS s(shape) WHERE dt <> ''""")
def date_shapes(spark, d):
    r = table(spark, d, "responses").where("category = 'extract'").select("response_id", F.regexp_extract("input", r"data (\d{4}-\d{2}-\d{2})", 1).alias("dt")).where("dt <> ''").distinct()
    month = lambda k: F.element_at(F.array(*[F.lit(m[k]) for m in values.MONTHS]), F.expr("cast(substr(dt, 6, 2) as int)"))
    named = [F.concat(F.expr("substr(dt, 9, 2)"), F.lit(" "), month(k), F.lit(" "), F.expr("substr(dt, 1, 4)"), F.lit(end)) for k, end in ((0, ""), (1, " R."))]
    each = r.select("response_id", F.posexplode(F.array(*map(F.expr, _SHAPES), *named)).alias("shape", "v"))
    return each.select("response_id", "shape", values.date_value(F.col("v")).alias("day"))


@query("money_shapes", """WITH r AS (SELECT DISTINCT response_id, regexp_extract(input, 'razem ([0-9]+),([0-9]{2}) zł', 1) AS a, regexp_extract(input, 'razem ([0-9]+),([0-9]{2}) zł', 2) AS b FROM responses WHERE category = 'extract') SELECT response_id, shape, CAST(CAST(a AS BIGINT) AS VARCHAR) || CASE WHEN b = '00' THEN '' ELSE '.' || rtrim(b, '0') END AS amount FROM r, (VALUES (0), (1), (2), (3)) AS s(shape) WHERE a <> ''""")
def money_shapes(spark, d):
    p = r"razem ([0-9]+),([0-9]{2}) zł"
    r = table(spark, d, "responses").where("category = 'extract'").select("response_id", F.regexp_extract("input", p, 1).alias("a"), F.regexp_extract("input", p, 2).alias("b")).where("a <> ''").distinct()
    point = F.regexp_replace("a", r"(?<=\d)(?=(?:\d{3})+$)", ".")
    shapes = F.array(F.concat("a", F.lit(","), "b", F.lit(" zł")), F.concat("a", F.lit("."), "b", F.lit(" PLN")), F.concat(point, F.lit(","), "b", F.lit(" ZŁ.")), F.concat(F.translate(point, ".", " "), F.lit(","), "b"))
    return r.select("response_id", F.posexplode(shapes).alias("shape", "v")).select("response_id", "shape", values.money_value(F.col("v")).alias("amount"))


@query("grouped_page_split", """WITH RECURSIVE p AS (SELECT DISTINCT id, document_id, edition_id FROM page_meta WHERE document_id IS NOT NULL), n AS (SELECT id, 'd' || document_id AS k FROM p UNION SELECT id, 'e' || edition_id FROM p WHERE edition_id IS NOT NULL), e AS (SELECT DISTINCT a.k AS u, b.k AS v FROM n a JOIN n b ON a.id = b.id),
r(x, y) AS (SELECT u, u FROM e UNION SELECT r.x, e.v FROM r JOIN e ON r.y = e.u), m AS (SELECT x, min(y) AS root FROM r GROUP BY x), g AS (SELECT DISTINCT p.id, m.root FROM p JOIN m ON m.x = 'd' || p.document_id)
SELECT CASE WHEN CAST('0x' || substr(sha256(root), 1, 8) AS BIGINT) % 10 = 0 THEN 'validation' ELSE 'train' END AS split, count(DISTINCT root) AS groups, count(DISTINCT id) AS pages FROM g GROUP BY 1""")
def grouped_page_split(spark, d):
    p = table(spark, d, "page_meta").where("document_id is not null").select("id", F.concat(F.lit("d"), "document_id").alias("u"), F.concat(F.lit("e"), "edition_id").alias("v")).distinct()
    labels = graph.components(p.where("v is not null").select("u", "v"), Scratch(spark, "split"))
    named = labels.join(labels.groupBy("root").agg(F.min("v").alias("least")), "root").select(F.col("v").alias("u"), "least")
    g = p.join(named, "u", "left").select("id", F.coalesce("least", "u").alias("root"))
    split = F.when(values.hash_bucket(F.col("root")) == 0, "validation").otherwise("train")
    return g.groupBy(split.alias("split")).agg(F.count_distinct("root").alias("groups"), F.count_distinct("id").alias("pages"))


_TEXTS = f"""WITH {CURRENT}, r AS (SELECT lower({normal_sql("reference")}) AS x, {split_sql("split")} AS s FROM cur WHERE reference IS NOT NULL), c AS (SELECT x, bool_or(s = 'train') AS t, bool_or(s <> 'train') AS h FROM r WHERE s IS NOT NULL GROUP BY x), k AS (SELECT x, t, h, string_split(x, ' ') AS w FROM c),
g AS (SELECT x, t, h, list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM k WHERE len(w) >= 3), u AS (SELECT x, t, h, len(g) AS n, unnest(g) AS q FROM g),
j AS (SELECT a.x AS a, b.x AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM u a JOIN u b ON a.q = b.q AND a.x <> b.x AND a.t AND b.h GROUP BY a.x, b.x)"""


@query("split_text_overlaps", _TEXTS + " SELECT sha256(a) AS train, sha256(b) AS held, common, round(common / (na + nb - common), 6) AS jaccard, round(common / least(na, nb), 6) AS containment FROM j WHERE common / (na + nb - common) >= 0.8 - 1e-9 OR common / least(na, nb) >= 0.8 - 1e-9")
def split_text_overlaps(spark, d):
    r = records(spark, d, "reference", "split").select(F.lower(normalize_v1(F.col("reference"))).alias("x"), split_name(F.col("split")).alias("s")).where("x is not null and s is not null")
    c = r.groupBy("x").agg(F.bool_or(F.col("s") == "train").alias("t"), F.bool_or(F.col("s") != "train").alias("h")).withColumn("w", words(F.col("x"))).where("size(w) >= 3")
    sets = c.select(F.sha2("x", 256).alias("k"), "t", "h", shingles(F.col("w"), 3).alias("g"))
    got = similarity.contained_pairs(sets.where("t").select(F.col("k").alias("a"), "g"), sets.where("h").select(F.col("k").alias("b"), "g"), "g", 0.8)
    return got.select(F.col("a").alias("train"), F.col("b").alias("held"), F.col("common").cast("bigint").alias("common"), F.round("jaccard", 6).alias("jaccard"), F.round("containment", 6).alias("containment"))
