"""Integrity, leakage and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrament.functions.fold import current_records, split_name
from atrament.functions.geometry import sign_bits
from atrament.functions.text import normalize_v1, shingles, words
from atrament.operators import contracts, graph, similarity
from atrament.plans.registry import CURRENT, normal_sql, query, split_sql
from atrament.session import Scratch, table


def records(spark, d, *cols):
    return current_records(table(spark, d, "printed_replay_geometry"), list(cols))


@query("missing_and_unknown_pages", """SELECT 'missing' AS rule, id AS key FROM (SELECT DISTINCT id FROM page_meta) WHERE id NOT IN (SELECT page_id FROM printed_replay_geometry WHERE page_id IS NOT NULL)
UNION ALL SELECT 'unknown', page_id FROM (SELECT DISTINCT page_id FROM printed_replay_geometry) WHERE page_id NOT IN (SELECT id FROM page_meta WHERE id IS NOT NULL)""")
def missing_and_unknown_pages(spark, d):
    pages, used = table(spark, d, "page_meta").select("id").distinct(), table(spark, d, "printed_replay_geometry").select(F.col("page_id").alias("id")).distinct()
    return contracts.violations(contracts.missing(pages, used, "id"), contracts.unknown(pages, used, "id")).select("rule", "key")


@query("contract_violations", """SELECT 'unique_key' AS rule, CAST(response_id AS VARCHAR) AS key FROM responses GROUP BY response_id HAVING count(*) > 1 OR response_id IS NULL
UNION ALL SELECT 'domain:status', CAST(response_id AS VARCHAR) FROM responses WHERE status IS NULL OR status NOT IN ('ok', 'error') UNION ALL SELECT 'finite:elapsed_seconds', CAST(response_id AS VARCHAR) FROM responses WHERE elapsed_seconds < 0 OR isnan(elapsed_seconds) OR isinf(elapsed_seconds)
UNION ALL SELECT 'format:image_sha256', id FROM page_meta WHERE NOT coalesce(regexp_full_match(image_sha256, '[0-9a-f]{64}'), false)""")
def contract_violations(spark, d):
    r, p = table(spark, d, "responses"), table(spark, d, "page_meta")
    return contracts.violations(contracts.unique_key(r, "response_id"), contracts.in_domain(r, "response_id", "status", ["ok", "error"]), contracts.finite(r, "response_id", "elapsed_seconds"), contracts.matches(p, "id", "image_sha256", "^[0-9a-f]{64}$")).select("rule", "key")


@query("duplicate_text_groups", """SELECT sha256(text) AS digest, count(*) AS n, count(DISTINCT source) AS sources, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def duplicate_text_groups(spark, d):
    got = table(spark, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"), F.min("doc_id").alias("first_id"))
    return got.where("n > 1")


@query("current_records_by_split", f"""WITH {CURRENT} SELECT {split_sql("split")} AS split, count(*) AS records, count(DISTINCT page_id) AS pages FROM cur GROUP BY 1""")
def current_records_by_split(spark, d):
    return records(spark, d, "split", "page_id").groupBy(split_name(F.col("split")).alias("split")).agg(F.count(F.lit(1)).alias("records"), F.countDistinct("page_id").alias("pages"))


@query("references_in_several_splits", f"""WITH {CURRENT}, r AS (SELECT sha256(reference) AS key, {split_sql("split")} AS split FROM cur WHERE reference IS NOT NULL)
SELECT key, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits, count(*) AS rows FROM r WHERE split IS NOT NULL GROUP BY key HAVING count(DISTINCT split) > 1""")
def references_in_several_splits(spark, d):
    r = records(spark, d, "reference", "split").select(F.sha2("reference", 256).alias("key"), split_name(F.col("split")).alias("split"))
    return similarity.shared_keys(r, "key", "split").withColumn("splits", F.array_join("splits", ","))


@query("values_beyond_train", f"""WITH {CURRENT}, r AS (SELECT collection, {split_sql("split")} AS split FROM cur)
SELECT collection, array_to_string(list_sort(list(DISTINCT split) FILTER (split <> 'train')), ',') AS others FROM r WHERE collection IS NOT NULL GROUP BY collection HAVING bool_or(split = 'train') AND count(DISTINCT split) FILTER (split <> 'train') > 0""")
def values_beyond_train(spark, d):
    r = records(spark, d, "collection", "split").withColumn("split", split_name(F.col("split")))
    return similarity.disjoint_values(r, "collection", "split").select("collection", F.array_join("others", ",").alias("others"))


NEAR = f"""WITH t AS (SELECT DISTINCT lower({normal_sql("output")}) AS x FROM responses WHERE output IS NOT NULL), c AS (SELECT sha256(x) AS k, list_filter(string_split(x, ' '), lambda w: w <> '') AS w FROM t),
s AS (SELECT k, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS t FROM c WHERE len(w) > 0),
u AS (SELECT k, len(t) AS n, unnest(t) AS g FROM s), j AS (SELECT a.k AS a, b.k AS b, a.n AS na, b.n AS nb, count(*) AS common FROM u a JOIN u b ON a.g = b.g AND a.k < b.k GROUP BY ALL)"""


@query("near_answers", NEAR + " SELECT a, b, common, round(common / (na + nb - common), 6) AS jaccard FROM j WHERE common / (na + nb - common) >= 0.5 - 1e-9")
def near_answers(spark, d):
    t = table(spark, d, "responses").where("output is not null").select(F.lower(normalize_v1(F.col("output"))).alias("x")).distinct()
    got = similarity.prefix_pairs(t.select(F.sha2("x", 256).alias("k"), shingles(words(F.col("x")), 3).alias("t")), "k", "t", 0.5)
    return got.withColumn("common", F.col("common").cast("bigint")).withColumn("jaccard", F.round("jaccard", 6))


@query("near_vectors", """WITH h AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN CAST(1 AS HUGEINT) << (i - 1) ELSE CAST(0 AS HUGEINT) END)) AS v FROM embeddings),
b AS (SELECT vec_id, CAST(v % 4294967296 AS BIGINT) AS lo, CAST(v // 4294967296 AS BIGINT) AS hi FROM h)
SELECT x.vec_id AS a, y.vec_id AS b, CAST(bit_count(xor(x.lo, xor(y.lo, (1 << (y.vec_id % 12)) - 1))) + bit_count(xor(x.hi, y.hi)) AS INTEGER) AS distance FROM b x JOIN b y ON bit_count(xor(x.lo, xor(y.lo, (1 << (y.vec_id % 12)) - 1))) + bit_count(xor(x.hi, y.hi)) <= 6""")
def near_vectors(spark, d):
    """Vectors and their second scans, of which up to eleven bits differ, within the radius of image hashes."""
    v = table(spark, d, "embeddings").select("vec_id", sign_bits(F.col("embedding")).alias("bits"))
    again = v.select(F.col("vec_id").alias("b"), F.col("bits").bitwiseXOR(F.expr("shiftleft(1L, cast(vec_id % 12 as int)) - 1")).alias("bits"))
    return similarity.hamming_pairs(v.withColumnRenamed("vec_id", "a"), again, "bits", 6)


@query("document_components", """WITH RECURSIVE p AS (SELECT DISTINCT id, document_id, edition_id FROM page_meta), e AS (SELECT DISTINCT 'd' || document_id AS u, 'e' || edition_id AS v FROM p WHERE document_id IS NOT NULL AND edition_id IS NOT NULL),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(x, y) AS (SELECT u, u FROM b UNION SELECT r.x, b.v FROM r JOIN b ON r.y = b.u), m AS (SELECT x, min(y) AS root FROM r GROUP BY x)
SELECT m.root, count(DISTINCT p.id) AS pages FROM p JOIN m ON m.x = 'd' || p.document_id GROUP BY m.root""")
def document_components(spark, d):
    p = table(spark, d, "page_meta").select("id", F.concat(F.lit("d"), "document_id").alias("u"), F.concat(F.lit("e"), "edition_id").alias("v")).distinct()
    labels = graph.components(p.where("u is not null and v is not null").select("u", "v"), Scratch(spark, "components"))
    least = labels.groupBy("root").agg(F.min("v").alias("least"))
    named = labels.join(least, "root").select(F.col("v").alias("u"), F.col("least").alias("root"))
    return p.join(named, "u").groupBy("root").agg(F.countDistinct("id").alias("pages"))


@query("checksum_audit", """WITH l AS (SELECT id AS path, min(image_sha256) AS listed FROM page_meta GROUP BY 1), a AS (SELECT page_id AS path, min(image_sha256) AS actual FROM printed_replay_geometry GROUP BY 1)
SELECT path, CASE WHEN actual IS NULL THEN 'missing' WHEN listed IS NULL THEN 'unlisted' WHEN listed = actual THEN 'ok' ELSE 'changed' END AS state FROM l FULL JOIN a USING (path)""")
def checksum_audit(spark, d):
    listed = table(spark, d, "page_meta").groupBy(F.col("id").alias("path")).agg(F.min("image_sha256").alias("sha256"))
    actual = table(spark, d, "printed_replay_geometry").groupBy(F.col("page_id").alias("path")).agg(F.min("image_sha256").alias("sha256"))
    return contracts.checksum_audit(listed, actual).select("path", "state")


@query("set_operations", """SELECT 'both' AS part, count(*) AS n FROM (SELECT collection FROM page_meta INTERSECT SELECT collection FROM documents) UNION ALL SELECT 'pages only', count(*) FROM (SELECT collection FROM page_meta EXCEPT SELECT collection FROM documents)
UNION ALL SELECT 'surplus rows', count(*) FROM (SELECT id FROM page_meta EXCEPT ALL SELECT DISTINCT id FROM page_meta) UNION ALL SELECT 'all', count(*) FROM (SELECT collection FROM page_meta UNION SELECT collection FROM documents)""")
def set_operations(spark, d):
    p, q, i = table(spark, d, "page_meta").select("collection"), table(spark, d, "documents").select("collection"), table(spark, d, "page_meta").select("id")
    parts = {"both": p.intersect(q), "pages only": p.subtract(q), "surplus rows": i.exceptAll(i.distinct()), "all": p.union(q).distinct()}
    out = None
    for name, df in parts.items():
        x = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = x if out is None else out.union(x)
    return out


@query("text_with_fallback", f"""WITH {CURRENT}, a AS (SELECT response_id, any_value(output) AS output FROM responses WHERE status = 'ok' GROUP BY 1), s AS (SELECT DISTINCT spot_id, page_id FROM uffd_evidence), n AS (SELECT page_id, min(text) AS text FROM cur GROUP BY 1)
SELECT s.spot_id, coalesce(a.output, n.text, '') <> '' AS found FROM s LEFT JOIN a ON a.response_id = s.spot_id LEFT JOIN n ON n.page_id = replace(s.page_id, 'NBG', 'PRG')""")
def text_with_fallback(spark, d):
    a = table(spark, d, "responses").where("status = 'ok'").groupBy("response_id").agg(F.min("output").alias("output"))
    n = records(spark, d, "page_id", "text").groupBy("page_id").agg(F.min("text").alias("text"))
    s = table(spark, d, "uffd_evidence").select("spot_id", F.replace("page_id", F.lit("NBG"), F.lit("PRG")).alias("page_id")).distinct()
    return s.join(a, s.spot_id == a.response_id, "left").join(n, "page_id", "left").select("spot_id", (F.coalesce("output", "text", F.lit("")) != "").alias("found"))
