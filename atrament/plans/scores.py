"""Scoring queries over answers and line records."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from atrament.functions import values
from atrament.functions.fold import current_records, split_name
from atrament.functions.text import normalize_v1
from atrament.operators import scoring
from atrament.plans.registry import CURRENT, distance_sql, normal_sql, query, split_sql, word_distance_sql
from atrament.session import table

ANSWERS = f"""WITH r AS (SELECT DISTINCT response_id, category, requested_model, status, finish_reason, elapsed_seconds, id AS case_id, {normal_sql("reference")} AS reference, {normal_sql("output")} AS output FROM responses),
p0 AS (SELECT *, coalesce(status = 'ok', false) AS ok, CASE WHEN status = 'ok' THEN coalesce(output, '') ELSE '' END AS hypothesis FROM r WHERE reference IS NOT NULL AND category <> 'extract'),
p AS MATERIALIZED (SELECT *, CAST({distance_sql("reference", "hypothesis")} AS BIGINT) AS e, length(reference) AS n, CAST({word_distance_sql("reference", "hypothesis")} AS BIGINT) AS we, len(list_filter(string_split(reference, ' '), lambda w: w <> '')) AS wn FROM p0)"""
RATES = "count(*) AS rows, count(*) FILTER (NOT ok) AS failed, CAST(sum(e) AS BIGINT) AS char_edits, CAST(sum(n) AS BIGINT) AS chars, round(sum(e) / nullif(sum(n), 0), 6) AS cer"
WORD_RATES = "CAST(sum(we) AS BIGINT) AS word_edits, CAST(sum(wn) AS BIGINT) AS words, round(sum(we) / nullif(sum(wn), 0), 6) AS wer"
LINES = f"""WITH {CURRENT}, p0 AS (SELECT floor(min_word_confidence / 10) AS decile, {split_sql("split")} AS split, {normal_sql("reference")} AS a, coalesce({normal_sql("text")}, '') AS b, text IS NOT NULL AS ok FROM cur WHERE reference IS NOT NULL),
p AS MATERIALIZED (SELECT *, {distance_sql("a", "b")} AS e, length(a) AS n, CAST({word_distance_sql("a", "b")} AS BIGINT) AS we, len(list_filter(string_split(a, ' '), lambda w: w <> '')) AS wn FROM p0)"""


def answers(spark, d):
    r = table(spark, d, "responses").select("response_id", "category", "requested_model", "status", "finish_reason", "elapsed_seconds", F.col("id").alias("case_id"), "reference", "output").distinct()
    ref = r.where("reference is not null and category <> 'extract'").select("response_id", "case_id", "category", "requested_model", "reference", "elapsed_seconds")
    return scoring.scored_join(ref, r.select("response_id", "status", "output"), "response_id", "reference", "output")


@query("answer_cer_by_category", ANSWERS + f" SELECT category, requested_model, {RATES}, {WORD_RATES} FROM p GROUP BY GROUPING SETS ((), (category), (requested_model))")
def answer_cer_by_category(spark, d):
    return scoring.error_rates(scoring.with_edits(answers(spark, d)), [[], ["category"], ["requested_model"]]).withColumns({c: F.round(c, 6) for c in ("cer", "wer")})


def lines(spark, d):
    rows = current_records(table(spark, d, "printed_replay_geometry"), ["text", "reference", "min_word_confidence", "split"]).where("reference is not null")
    return rows.select("id", F.floor(F.col("min_word_confidence") / 10).alias("decile"), split_name(F.col("split")).alias("split"), normalize_v1(F.col("reference")).alias("reference"), F.coalesce(normalize_v1(F.col("text")), F.lit("")).alias("hypothesis"), F.col("text").isNotNull().alias("ok"))


@query("line_cer_by_confidence", LINES + f" SELECT CAST(decile AS BIGINT) AS decile, {RATES} FROM p GROUP BY GROUPING SETS ((), (decile))")
def line_cer_by_confidence(spark, d):
    return scoring.error_rates(scoring.with_edits(lines(spark, d), word_level=False), [[], ["decile"]]).withColumn("cer", F.round("cer", 6))


@query("line_wer_micro", LINES + f" SELECT {RATES.replace('count(*) FILTER (NOT ok) AS failed, ', '')}, {WORD_RATES} FROM p")
def line_wer_micro(spark, d):
    got = scoring.error_rates(scoring.with_edits(lines(spark, d)), [[]]).select("rows", "char_edits", "chars", "cer", "word_edits", "words", "wer")
    return got.withColumns({c: F.round(c, 6) for c in ("cer", "wer")})


@query("domain_summary", LINES + f""", d AS (SELECT coalesce(split, 'none') AS domain, * FROM p UNION ALL SELECT 'combined', * FROM p)
SELECT domain, count(*) AS lines, round(sum(e) / nullif(sum(n), 0), 6) AS cer, round(sum(we) / nullif(sum(wn), 0), 6) AS wer, CAST(sum(length(b) - length(replace(b, chr(65533), ''))) AS BIGINT) AS replacement_characters FROM d GROUP BY domain""")
def domain_summary(spark, d):
    p = lines(spark, d).withColumn("domain", F.coalesce("split", F.lit("none")))
    got = scoring.domain_summary(scoring.with_edits(p), "domain")
    return got.withColumns({c: F.round(c, 6) for c in ("cer", "wer")})


@query("scored_subsets", LINES + f""", s AS (SELECT 'all' AS subset, * FROM p UNION ALL SELECT 'no_private', * FROM p WHERE NOT regexp_matches(a, '\\p{{Co}}') UNION ALL SELECT 'read', * FROM p WHERE ok UNION ALL SELECT 'changed', * FROM p WHERE a <> b)
SELECT subset, {RATES} FROM s GROUP BY subset""")
def scored_subsets(spark, d):
    p = scoring.with_edits(lines(spark, d), word_level=False)
    got = scoring.subset_rates(p, {"all": F.lit(True), "no_private": ~F.col("reference").rlike(r"\p{Co}"), "read": F.col("ok"), "changed": F.expr("reference <> hypothesis")})
    return got.withColumn("cer", F.round("cer", 6))


@query("lower_case_effect", LINES + f""" SELECT CAST(sum(e) AS BIGINT) AS char_edits, CAST(sum({distance_sql("lower(a)", "lower(b)")}) AS BIGINT) AS lower_edits, CAST(sum(n) AS BIGINT) AS chars FROM p""")
def lower_case_effect(spark, d):
    p = scoring.with_edits(lines(spark, d), word_level=False)
    return p.agg(F.sum("char_edits").alias("char_edits"), F.sum(F.levenshtein(F.lower("reference"), F.lower("hypothesis"))).alias("lower_edits"), F.sum("chars").alias("chars"))


@query("status_histogram", "SELECT status, finish_reason, count(*) AS n FROM (SELECT DISTINCT * FROM responses) GROUP BY ALL")
def status_histogram(spark, d):
    return table(spark, d, "responses").distinct().groupBy("status", "finish_reason").agg(F.count(F.lit(1)).alias("n"))


@query("latency_by_model", """SELECT requested_model, count(s) AS timed, round(avg(s), 6) AS mean, max(s) AS "max", round(sum(s), 4) AS total
FROM (SELECT DISTINCT response_id, requested_model, CASE WHEN elapsed_seconds >= 0 THEN elapsed_seconds END AS s FROM responses) GROUP BY requested_model""")
def latency_by_model(spark, d):
    r = table(spark, d, "responses").select("response_id", "requested_model", "elapsed_seconds").distinct()
    return scoring.timing(r, "elapsed_seconds", ["requested_model"]).withColumn("mean", F.round("mean", 6)).withColumn("total", F.round("total", 4))


FIELDS = {"invoice_number": "text", "seller_name": "text", "seller_nip": "nip", "issue_date": "date", "total": "money"}


def fields(spark, d):
    r = table(spark, d, "responses").where("category = 'extract' and reference is not null").select("response_id", "source", "status", "output", "reference").distinct()
    out = F.when(F.col("status") == "ok", F.when(F.try_parse_json("output").isNotNull(), F.col("output")))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind"), F.get_json_object("reference", f"$.{f}").alias("reference"), F.get_json_object(out, f"$.{f}").alias("predicted")) for f, k in FIELDS.items()]))
    return scoring.field_verdicts(r.select("response_id", "source", cells.alias("c")).select("response_id", "source", "c.*"))


@query("field_f1_grouping_sets", """WITH r AS (SELECT DISTINCT response_id, source, reference, CASE WHEN status = 'ok' AND json_valid(output) THEN output END AS output FROM responses WHERE category = 'extract' AND reference IS NOT NULL),
f AS (SELECT source, u.field, u.kind, json_extract_string(reference, '$.' || u.field) AS a, json_extract_string(output, '$.' || u.field) AS b FROM r, (VALUES ('invoice_number', 'text'), ('seller_name', 'text'), ('seller_nip', 'nip'), ('issue_date', 'date'), ('total', 'money')) AS u(field, kind)),
n AS (SELECT source, field, kind, CASE kind WHEN 'money' THEN regexp_replace(regexp_replace(a, '(\\.\\d*?)0+$', '\\1'), '\\.$', '') ELSE """ + f"lower({normal_sql('a')})" + """ END AS a, CASE kind WHEN 'money' THEN regexp_replace(regexp_replace(b, '(\\.\\d*?)0+$', '\\1'), '\\.$', '') ELSE """ + f"lower({normal_sql('b')})" + """ END AS b FROM f),
v AS (SELECT kind, source, field, CASE WHEN a IS NULL AND b IS NULL THEN 'absent' WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'spurious' WHEN a = b THEN 'match' ELSE 'mismatch' END AS verdict FROM n),
g AS (SELECT field, kind, source, count(*) FILTER (verdict = 'match') AS tp, count(*) FILTER (verdict IN ('mismatch', 'spurious')) AS fp, count(*) FILTER (verdict IN ('mismatch', 'missing')) AS fn FROM v WHERE verdict <> 'absent' GROUP BY GROUPING SETS ((), (kind), (source, field)))
SELECT field, kind, source, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM g""")
def field_f1_grouping_sets(spark, d):
    got = scoring.field_f1(fields(spark, d), [[], ["kind"], ["source", "field"]])
    return got.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("money_and_dates", """WITH r AS (SELECT DISTINCT response_id, input FROM responses WHERE category = 'extract' AND input IS NOT NULL), x AS (SELECT response_id, regexp_extract(input, 'razem ([0-9,.]+) zł', 1) AS m, regexp_extract(input, 'data (\\d{4}-\\d{2}-\\d{2})', 1) AS dt FROM r)
SELECT response_id, regexp_replace(regexp_replace(replace(m, ',', '.'), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS amount, dt AS day FROM x WHERE m <> ''""")
def money_and_dates(spark, d):
    r = table(spark, d, "responses").where("category = 'extract' and input is not null").select("response_id", "input").distinct()
    x = r.select("response_id", F.regexp_extract("input", "razem ([0-9,.]+) zł", 1).alias("m"), F.regexp_extract("input", r"data (\d{4}-\d{2}-\d{2})", 1).alias("dt")).where("m <> ''")
    return x.select("response_id", values.money_value(F.concat("m", F.lit(" zł"))).alias("amount"), values.date_value(F.col("dt")).alias("day"))


@query("paired_models", ANSWERS + """, s AS (SELECT case_id, category, requested_model, round(avg(e / greatest(n, 1)), 9) AS cer FROM p WHERE requested_model IN ('korektor-mały', 'korektor-duży') GROUP BY ALL),
j AS (SELECT a.category, b.cer - a.cer AS delta FROM s a JOIN s b ON a.case_id = b.case_id AND a.category = b.category AND a.requested_model = 'korektor-mały' AND b.requested_model = 'korektor-duży')
SELECT category, count(*) FILTER (delta < -1e-12) AS improved, count(*) FILTER (delta > 1e-12) AS regressed, count(*) FILTER (abs(delta) <= 1e-12) AS tied, round(sum(delta), 6) AS net FROM j GROUP BY category""")
def paired_models(spark, d):
    s = scoring.with_edits(answers(spark, d), word_level=False).groupBy("case_id", "category", "requested_model").agg(F.round(F.avg(F.col("char_edits") / F.greatest("chars", F.lit(1))), 9).alias("cer"))
    a, b = (s.where(F.col("requested_model") == m).select("case_id", "category", F.col("cer").alias(x)) for m, x in (("korektor-mały", "a"), ("korektor-duży", "b")))
    return scoring.change_counts(a.join(b, ["case_id", "category"]).withColumn("delta", F.col("b") - F.col("a")), ["category"]).withColumn("net", F.round("net", 6))


@query("composite_score", ANSWERS + """, c AS (SELECT 1 - sum(e) / sum(n) AS a FROM p),
f AS (SELECT avg(CASE WHEN status = 'ok' AND json_valid(output) AND json_extract_string(output, '$.invoice_number') = json_extract_string(reference, '$.invoice_number') THEN 1.0 ELSE 0.0 END) AS b FROM (SELECT DISTINCT response_id, status, output, reference FROM responses WHERE category = 'extract' AND reference IS NOT NULL))
SELECT round((a + b) / 2, 6) AS composite FROM c, f""")
def composite_score(spark, d):
    c = scoring.with_edits(answers(spark, d), word_level=False).agg((1 - F.sum("char_edits") / F.sum("chars")).alias("a")).withColumn("k", F.lit(1))
    f = fields(spark, d).where("field = 'invoice_number'").agg(F.avg((F.col("verdict") == "match").cast("double")).alias("b")).withColumn("k", F.lit(1))
    return c.join(F.broadcast(f), "k").select(F.round((F.col("a") + F.col("b")) / 2, 6).alias("composite"))  # one row each


#: The same hash and weights as in the operator.
_DRAWS, _P = 500, scoring.PRIME
_POISSON = " + ".join(f"CAST(u >= {sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))!r} AS INT)" for k in range(8))


@query("bootstrap_interval", ANSWERS + f""", s AS (SELECT case_id, category, requested_model AS m, min(response_id) AS key, sum(e) AS e, max(n) AS n, count(*) AS c FROM p WHERE requested_model IN ('korektor-mały', 'korektor-duży') GROUP BY ALL),
j AS (SELECT least(x.key, y.key) AS key, x.e AS a, y.e AS b, x.n FROM s x JOIN s y ON x.case_id = y.case_id AND x.category = y.category AND x.m = 'korektor-mały' AND y.m = 'korektor-duży' WHERE x.c = 1 AND y.c = 1),
h AS (SELECT draw, a, b, n, (key % {_P} * 48271 + draw * 69621 + 12345) % {_P} AS x FROM j, range({_DRAWS}) t(draw)), h2 AS (SELECT draw, a, b, n, x, (x * x + x) % {_P} AS y FROM h), h3 AS (SELECT draw, a, b, n, ((y * 16807 + x) % {_P}) / {_P} AS u FROM h2),
w AS (SELECT draw, a, b, n, {_POISSON} AS w FROM h3), g AS (SELECT sum(w * (b - a)) / nullif(sum(w * n), 0) AS v FROM w GROUP BY draw), o AS (SELECT list(v ORDER BY v) AS l FROM g WHERE v IS NOT NULL)
SELECT round((SELECT sum(b - a) / sum(n) FROM j), 9) AS change, round(l[least(len(l) - 1, CAST(floor(0.025 * len(l)) AS INT)) + 1], 9) AS low, round(l[least(len(l) - 1, CAST(floor(0.975 * len(l)) AS INT)) + 1], 9) AS high, len(list_filter(l, lambda v: v < 0)) / len(l) AS share_better FROM o""")
def bootstrap_interval(spark, d):
    s = scoring.with_edits(answers(spark, d), word_level=False).groupBy("case_id", "category", "requested_model").agg(F.min("response_id").alias("key"), F.sum("char_edits").alias("e"), F.max("chars").alias("n"), F.count(F.lit(1)).alias("c"))
    one = lambda m, x: s.where((F.col("requested_model") == m) & (F.col("c") == 1)).select("case_id", "category", F.col("key").alias(f"key_{x}"), F.col("e").alias(x), F.col("n").alias(f"n_{x}"))
    j = one("korektor-mały", "a").join(one("korektor-duży", "b"), ["case_id", "category"]).select(F.least("key_a", "key_b").alias("key"), "a", "b", F.col("n_a").alias("chars"))
    got = scoring.bootstrap(j, _DRAWS)
    return got.withColumns({c: F.round(c, 9) for c in ("change", "low", "high")})


@query("candidate_gate", ANSWERS + """, s AS (SELECT requested_model AS name, sum(e) / nullif(sum(n), 0) AS cer, avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END) AS failed FROM p WHERE requested_model IS NOT NULL GROUP BY 1)
SELECT coalesce((SELECT name FROM s WHERE failed <= 0.2 ORDER BY round(cer, 9), name LIMIT 1), 'baseline') AS chosen""")
def candidate_gate(spark, d):
    s = scoring.with_edits(answers(spark, d), word_level=False).where("requested_model is not null").groupBy(F.col("requested_model").alias("name"))
    s = s.agg(F.round(F.sum("char_edits") / F.nullif(F.sum("chars"), F.lit(0)), 9).alias("cer"), F.avg((~F.col("ok")).cast("double")).alias("failed"))
    return scoring.best_candidate(s, F.col("failed") <= 0.2, "cer", "name", "baseline")


@query("correction_effect", ANSWERS + """, i AS (SELECT DISTINCT response_id, """ + normal_sql("input") + """ AS input FROM responses)
SELECT category, count(*) AS rows, count(*) FILTER (hypothesis = reference) AS exact, count(*) FILTER (category = 'preserve_clean' AND hypothesis <> reference) AS clean_changed, CAST(sum(e) - sum(""" + distance_sql("reference", "input") + """) AS BIGINT) AS net_edits FROM p JOIN i USING (response_id) WHERE ok AND category IN ('preserve_clean', 'repair_synthetic') GROUP BY category""")
def correction_effect(spark, d):
    i = table(spark, d, "responses").select("response_id", normalize_v1(F.col("input")).alias("input")).distinct()
    s = scoring.with_edits(answers(spark, d), word_level=False).where("ok and category in ('preserve_clean', 'repair_synthetic')").join(i, "response_id")
    return s.groupBy("category").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.expr("hypothesis = reference")).alias("exact"), F.count_if(F.expr("category = 'preserve_clean' and hypothesis <> reference")).alias("clean_changed"), (F.sum("char_edits") - F.sum(F.levenshtein("reference", "input"))).cast("bigint").alias("net_edits"))


@query("error_profile")
def error_profile(spark, d):
    rows = current_records(table(spark, d, "printed_replay_geometry"), ["text", "reference"]).where("reference is not null and text is not null and reference <> text")
    return scoring.error_profile(rows.withColumnRenamed("text", "hypothesis"))


@query("glyph_inventory", """SELECT glyph, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'), '')) AS glyph FROM documents WHERE text IS NOT NULL) WHERE glyph <> '' GROUP BY glyph""")
def glyph_inventory(spark, d):
    return scoring.glyph_inventory(table(spark, d, "documents").where("text is not null"), "text")


@query("running_best_models", """WITH s AS (SELECT DISTINCT response_id, requested_model, created_at, elapsed_seconds FROM responses WHERE elapsed_seconds IS NOT NULL AND requested_model IS NOT NULL AND created_at IS NOT NULL), o AS (SELECT requested_model, response_id, elapsed_seconds, row_number() OVER (PARTITION BY requested_model ORDER BY created_at, response_id) AS step FROM s)
SELECT requested_model, response_id FROM (SELECT *, min(elapsed_seconds) OVER (PARTITION BY requested_model ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o) WHERE before IS NULL OR elapsed_seconds < before""")
def running_best_models(spark, d):
    s = table(spark, d, "responses").where("elapsed_seconds is not null and requested_model is not null and created_at is not null").select("response_id", "requested_model", "created_at", "elapsed_seconds").distinct()
    s = s.withColumn("step", F.expr("struct(created_at, response_id)"))
    return scoring.running_best(s, ["requested_model"], "step", "elapsed_seconds").where("best_so_far").select("requested_model", "response_id")
