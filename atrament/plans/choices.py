"""Selection and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrament.functions import text as X
from atrament.functions.fold import current_records
from atrament.functions.trees import outline_rows, structure_similarity
from atrament.functions.values import hash_bucket
from atrament.operators import select
from atrament.plans.registry import BLANKS, CURRENT, normal_sql, query
from atrament.session import table
from atrament.sources.writers import unpack_cells

DOCS = "d AS (SELECT doc_id, coalesce(source, '') AS source, sha256('s1' || chr(0) || doc_id) AS h, sha256('s1' || chr(0) || coalesce(source, '')) AS g FROM documents WHERE text IS NOT NULL)"


def docs(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))


@query("quota_per_source", f"WITH {DOCS} SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h) AS r FROM d) WHERE r <= 20")
def quota_per_source(spark, d):
    return select.per_group(docs(spark, d), "source", select.hash_rank("s1", "doc_id"), 20).select("source", "doc_id")


@query("round_robin_choice", f"WITH {DOCS} SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h) AS r FROM d) ORDER BY r, g LIMIT 60")
def round_robin_choice(spark, d):
    return select.round_robin(docs(spark, d), "source", "s1", "doc_id", 60).select("source", "doc_id")


@query("first_of_sources", f"WITH {DOCS} SELECT source, arg_min(doc_id, h) AS doc_id FROM d GROUP BY source, g ORDER BY g, source LIMIT 5")
def first_of_sources(spark, d):
    return select.first_of_groups(docs(spark, d), "source", "s1", "doc_id", 5)


@query("hash_bucket_split", """SELECT CASE WHEN CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 = 0 THEN 'validation' ELSE 'train' END AS split, count(*) AS docs FROM documents GROUP BY 1""")
def hash_bucket_split(spark, d):
    return table(spark, d, "documents").groupBy(F.when(hash_bucket(F.col("doc_id").cast("string")) == 0, "validation").otherwise("train").alias("split")).agg(F.count(F.lit(1)).alias("docs"))


@query("distinct_lines_first_polish", f"""WITH {CURRENT}, t AS (SELECT reference, bool_or(regexp_matches(reference, '[ąćęłńóśźżĄĆĘŁŃÓŚŹŻ]')) AS "first" FROM cur WHERE reference IS NOT NULL GROUP BY 1) SELECT reference, "first" FROM t ORDER BY "first" DESC, sha256(reference), reference LIMIT 100""")
def distinct_lines_first_polish(spark, d):
    rows = current_records(table(spark, d, "printed_replay_geometry"), ["reference"])
    return select.distinct_until(rows, "reference", F.col("reference").rlike(f"[{X.POLISH}]"), 100)


CLASS = "[A-Za-ząćęłńóśźżĄĆĘŁŃÓŚŹŻ]"


@query("sentence_quality", f"""WITH {CURRENT}, t AS (SELECT reference AS s FROM cur WHERE reference IS NOT NULL)
SELECT count(*) AS rows, count(*) FILTER (length(s) BETWEEN 20 AND 160 AND length(regexp_replace(s, '[^\\p{{L}}]', '', 'g')) >= 0.55 * length(s) AND length(regexp_replace(s, '[^()]', '', 'g')) <= 2 AND length(regexp_replace(s, '[^"]', '', 'g')) <= 4) AS good FROM t""")
def sentence_quality(spark, d):
    rows = current_records(table(spark, d, "printed_replay_geometry"), ["reference"]).where("reference is not null").select(F.col("reference").alias("s"))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(X.sentence_ok(F.col("s"))).alias("good"))


@query("noise_gate", f"""WITH {CURRENT}, t AS (SELECT min_word_confidence AS c, text AS s, list_filter(string_split_regex(text, '{BLANKS}'), lambda x: length(x) >= 4) AS w FROM cur WHERE text IS NOT NULL),
n AS (SELECT c, CASE WHEN trim({normal_sql("s")}) = '' THEN 1.0 ELSE least(1.0, 3.0 * (CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: NOT regexp_matches(x, '[aeiouyąęóAEIOUYĄĘÓ]'))) / len(w) ELSE 0 END) + 5.0 * length(regexp_replace(s, '[^@#$%^&*_=~<>|\\\\{{}}\\[\\]]', '', 'g')) / length(s) + 5.0 * length(regexp_replace(s, '[\\x{{0}}-\\x{{2500}}]', '', 'g')) / length(s)) END AS noise FROM t)
SELECT count(*) AS rows, count(*) FILTER (coalesce(1 - c / 100, noise) >= 0.15) AS gated, round(avg(noise), 6) AS noise FROM n""")
def noise_gate(spark, d):
    rows = current_records(table(spark, d, "printed_replay_geometry"), ["text", "min_word_confidence"]).where("text is not null").select(F.col("text").alias("s"), F.col("min_word_confidence").alias("c"))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(X.noise_gate(F.col("s"), F.col("c") / 100, 0.15)).alias("gated"), F.round(F.avg(X.noise(F.col("s"))), 6).alias("noise"))


@query("language_route", f"""WITH t AS (SELECT lower(trim(lang)) AS lang, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS n, length(regexp_replace(text, '[^{X.POLISH}]', '', 'g')) AS p FROM documents WHERE text IS NOT NULL)
SELECT CASE WHEN n > 0 AND p / n >= 0.02 THEN 'pl' ELSE coalesce(nullif(lang, ''), 'pl') END AS route, count(*) AS docs FROM t GROUP BY 1""")
def language_route(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.groupBy(X.route_language(F.col("text"), F.col("lang")).alias("route")).agg(F.count(F.lit(1)).alias("docs"))


@query("text_defects", """SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(length(text) - length(replace(text, chr(65533), '')) AS BIGINT) AS replacement, CAST(length(regexp_replace(text, '[^\\x{E000}-\\x{F8FF}]', '', 'g')) AS BIGINT) AS private FROM documents WHERE text IS NOT NULL""")
def text_defects(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    c = X.defect_counts(F.col("text"))
    return t.select("doc_id", *[c[k].cast("bigint").alias(k) for k in ("chars", "replacement", "private")])


@query("repeated_lines", """WITH l AS (SELECT DISTINCT page_no, unnest(lines, recursive := true) FROM ocr_pages), s AS (SELECT page_no, line_index, raw_text, row_number() OVER (PARTITION BY page_no ORDER BY line_index) - row_number() OVER (PARTITION BY page_no, raw_text ORDER BY line_index) AS island FROM l),
r AS (SELECT page_no, raw_text, island, count(*) AS n FROM s GROUP BY ALL) SELECT page_no, CAST(max(n) AS BIGINT) AS longest FROM r GROUP BY page_no""")
def repeated_lines(spark, d):
    p = table(spark, d, "ocr_pages").groupBy("page_no").agg(F.max("lines").alias("lines"))
    texts = F.transform(F.array_sort("lines", lambda a, b: F.coalesce(a["line_index"], F.lit(0)) - F.coalesce(b["line_index"], F.lit(0))), lambda x: x["raw_text"])
    return p.select("page_no", X.longest_run(texts).cast("bigint").alias("longest"))


@query("cells_round_trip", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def cells_round_trip(spark, d):
    t = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("pos"), F.col("doc_id").alias("id"), "text")
    cells = t.select("pos", X.escape_cell(F.col("text")).alias("cell"))
    return unpack_cells(t.select("pos", "id"), cells).select(F.col("id").alias("doc_id"), "text")


@query("top_words", """SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(reference), '[^\\p{L}]+')) AS w FROM (SELECT DISTINCT id, reference FROM printed_replay_geometry WHERE reference IS NOT NULL)) WHERE w <> '' GROUP BY w ORDER BY n DESC, w LIMIT 20""")
def top_words(spark, d):
    rows = table(spark, d, "printed_replay_geometry").where("reference is not null").select("id", "reference").distinct()
    w = rows.select(F.explode(F.split(F.lower("reference"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(20)


@query("triage_flags", """WITH r AS (SELECT DISTINCT response_id, output, finish_reason FROM responses WHERE output IS NOT NULL) SELECT count(*) AS rows, count(*) FILTER (finish_reason = 'length') AS token_limit, count(*) FILTER (finish_reason IS NULL) AS no_end, count(*) FILTER (regexp_matches(output, '[\\x{0400}-\\x{052F}]')) AS cyrillic FROM r""")
def triage_flags(spark, d):
    r = table(spark, d, "responses").where("output is not null").select("response_id", "output", "finish_reason").distinct().withColumn("f", X.triage(F.col("output"), F.col("finish_reason")))
    return r.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.array_contains("f", n)).alias(n) for n in ("token_limit", "no_end", "cyrillic")])


@query("exclusion_reasons", f"""WITH {CURRENT} SELECT CASE WHEN reference IS NULL THEN 'no reference' WHEN length(reference) < 20 THEN 'short' WHEN coalesce(min_word_confidence, 0) < 80 THEN 'unsure' WHEN collection IS NULL THEN 'no collection' ELSE 'kept' END AS reason, count(*) AS rows FROM cur GROUP BY 1""")
def exclusion_reasons(spark, d):
    rows = current_records(table(spark, d, "printed_replay_geometry"), ["reference", "min_word_confidence", "collection"])
    reason = X.first_reason((F.expr("reference is null"), "no reference"), (F.char_length("reference") < 20, "short"), (F.expr("coalesce(min_word_confidence, 0) < 80"), "unsure"), (F.expr("collection is null"), "no collection"), (F.lit(True), "kept"))
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


@query("outline_structure")
def outline_structure(spark, d):
    r = table(spark, d, "responses").where("reference is not null and output is not null").select("response_id", "reference", "output").distinct()
    return r.select("response_id", F.size(outline_rows("reference")).alias("parts"), structure_similarity("reference", "output").alias("structure"))
