"""Geometry, page and event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrament.functions import geometry as G
from atrament.functions.fold import current_records
from atrament.functions.trees import table_scores
from atrament.operators import asof, layout, review
from atrament.plans.registry import CURRENT, query
from atrament.session import Scratch, table
from atrament.streaming import workers


def boxes(spark, d, *more):
    return current_records(table(spark, d, "printed_replay_geometry"), ["page_id", "line_index", "bbox", *more])


@query("box_conflicts", f"""WITH {CURRENT}, b AS (SELECT page_id, id, [greatest(bbox[1] - 12, 0), greatest(bbox[2] - 12, 0), bbox[3] + 12, bbox[4] + 12] AS bbox FROM cur WHERE bbox[3] > bbox[1] AND bbox[4] > bbox[2]), j AS (SELECT a.page_id, a.id AS a, b.id AS b, greatest(least(a.bbox[3], b.bbox[3]) - greatest(a.bbox[1], b.bbox[1]), 0) * greatest(least(a.bbox[4], b.bbox[4]) - greatest(a.bbox[2], b.bbox[2]), 0) AS o,
 (a.bbox[3] - a.bbox[1]) * (a.bbox[4] - a.bbox[2]) AS x, (b.bbox[3] - b.bbox[1]) * (b.bbox[4] - b.bbox[2]) AS y FROM b a JOIN b ON a.page_id = b.page_id AND a.id < b.id)
SELECT page_id, a, b, round(o / (x + y - o), 6) AS iou, round(o / least(x, y), 6) AS inside FROM j WHERE o / (x + y - o) >= 0.02 OR o / least(x, y) >= 0.04""")
def box_conflicts(spark, d):
    b = F.col("bbox")
    padded = boxes(spark, d).where((b[2] > b[0]) & (b[3] > b[1])).withColumn("bbox", G.clamp(b, 12, F.lit(1 << 30), F.lit(1 << 30)))
    got = layout.conflicts(padded, "page_id", "id", "bbox", 0.02, 0.04)
    return got.withColumn("iou", F.round("iou", 6)).withColumn("inside", F.round("inside", 6))


@query("line_gaps", f"""WITH {CURRENT}, l AS (SELECT page_id, id, bbox, lead(bbox) OVER w AS n, lag(bbox) OVER w AS p FROM cur WINDOW w AS (PARTITION BY page_id ORDER BY line_index, id))
SELECT id, n[2] - bbox[4] AS gap, CAST(CASE WHEN p IS NULL THEN bbox[2] ELSE floor((p[4] + bbox[2]) / 2) END AS INTEGER) AS crop_top, CAST(CASE WHEN n IS NULL THEN bbox[4] ELSE ceil((bbox[4] + n[2]) / 2) END AS INTEGER) AS crop_bottom FROM l""")
def line_gaps(spark, d):
    rows = boxes(spark, d).withColumn("place", F.struct("line_index", "id"))
    return layout.line_gaps(rows, "page_id", "place", "bbox").select("id", "gap", "crop_top", "crop_bottom")


@query("page_gates", f"""WITH {CURRENT}, l AS (SELECT page_id, id, coalesce(min_word_confidence < 60, false) AS c, CASE WHEN text = reference THEN length(reference) ELSE 0 END AS m, coalesce(length(reference), 0) AS t FROM cur),
g AS (SELECT page_id, bool_or(c) AS conflict, coalesce(sum(m) / nullif(sum(t), 0), 0.0) AS coverage FROM l GROUP BY 1) SELECT page_id, conflict AS page_conflict, round(coverage, 6) AS coverage, NOT conflict AND (coverage >= 0.4 OR coverage = 0) AS accepted FROM g""")
def page_gates(spark, d):
    rows = boxes(spark, d, "text", "reference", "min_word_confidence")
    n = F.coalesce(F.char_length("reference"), F.lit(0))
    got = layout.page_gate(rows, "page_id", F.col("min_word_confidence") < 60, F.when(F.col("text") == F.col("reference"), n).otherwise(0), n)
    return got.select("page_id", "page_conflict", F.round("coverage", 6).alias("coverage"), "accepted").distinct()


@query("page_boxes", f"""WITH {CURRENT} SELECT page_id, min(bbox[1]) AS left_, min(bbox[2]) AS top_, max(bbox[3]) AS right_, max(bbox[4]) AS bottom_, median(bbox[4] - bbox[2]) AS height, round(min(min_word_confidence), 6) AS confidence FROM cur GROUP BY page_id""")
def page_boxes(spark, d):
    b = [F.get("bbox", F.lit(i)) for i in range(4)]
    return boxes(spark, d, "min_word_confidence").groupBy("page_id").agg(F.min(b[0]).alias("left_"), F.min(b[1]).alias("top_"), F.max(b[2]).alias("right_"), F.max(b[3]).alias("bottom_"), F.median(b[3] - b[1]).alias("height"), F.round(F.min("min_word_confidence"), 6).alias("confidence"))


@query("page_skews", f"""WITH {CURRENT}, l AS (SELECT page_id, floor(line_index / 8) AS part, regr_slope(CAST(bbox[1] AS DOUBLE), CAST(line_index AS DOUBLE)) AS slope FROM cur GROUP BY ALL)
SELECT page_id, round(median(degrees(atan(slope))), 6) AS skew, abs(median(degrees(atan(slope)))) > 5 AS rejected FROM l WHERE slope IS NOT NULL AND NOT isnan(slope) GROUP BY page_id""")
def page_skews(spark, d):
    rows = boxes(spark, d).select("page_id", F.floor(F.col("line_index") / 8).alias("part"), F.col("line_index").cast("double").alias("x"), F.get("bbox", F.lit(0)).cast("double").alias("y"))
    return layout.page_skew(rows, ["part"], "page_id", "x", "y").withColumn("skew", F.round("skew", 6))


@query("anchor_reasons", f"""WITH {CURRENT}, c AS (SELECT text, count(*) AS n FROM cur GROUP BY text)
SELECT CASE WHEN coalesce(min_word_confidence, 0) < 90 THEN 'low_confidence' WHEN length(text) < 20 OR len(regexp_split_to_array(trim(text), '\\s+')) < 3 THEN 'too_short' WHEN NOT regexp_matches(text, '\\p{{Ll}}') THEN 'not_line_like' WHEN regexp_matches(text, '[\\x{{FFFD}}\\x{{E000}}-\\x{{F8FF}}]') THEN 'invalid_glyph' WHEN coalesce(n, 0) <> 1 THEN 'not_unique' END AS reason, count(*) AS rows FROM cur LEFT JOIN c USING (text) GROUP BY 1""")
def anchor_reasons(spark, d):
    rows = boxes(spark, d, "text", "min_word_confidence")
    n = rows.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    got = rows.join(n, "text", "left")
    return got.groupBy(layout.anchor_reason(F.col("text"), F.col("min_word_confidence"), F.col("n")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


@query("ordered_slots", "SELECT page_id, list(line_index ORDER BY line_index)[1] AS first_slot, count(*) AS slots, max(line_index) - min(line_index) + 1 - count(*) AS holes FROM (SELECT DISTINCT page_id, line_index FROM printed_replay_geometry) GROUP BY page_id")
def ordered_slots(spark, d):
    rows = table(spark, d, "printed_replay_geometry").select("page_id", "line_index").distinct()
    s = rows.groupBy("page_id").agg(F.array_sort(F.collect_list("line_index")).alias("s"))
    return s.select("page_id", F.get("s", F.lit(0)).alias("first_slot"), F.size("s").cast("bigint").alias("slots"), (F.try_element_at("s", F.lit(-1)) - F.get("s", F.lit(0)) + 1 - F.size("s")).cast("bigint").alias("holes"))


@query("interpolated_numbers", """WITH p AS (SELECT DISTINCT page_no, work_family, page_number FROM ocr_pages), x AS (SELECT *, last_value(CASE WHEN page_number IS NOT NULL THEN page_no END IGNORE NULLS) OVER w AS bn, last_value(page_number IGNORE NULLS) OVER w AS bv, first_value(CASE WHEN page_number IS NOT NULL THEN page_no END IGNORE NULLS) OVER v AS an, first_value(page_number IGNORE NULLS) OVER v AS av FROM p
 WINDOW w AS (PARTITION BY work_family ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY work_family ORDER BY page_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT page_no, round(coalesce(bv + (page_no - bn) / nullif(an - bn, 0) * (av - bv), bv, av), 6) AS number FROM x""")
def interpolated_numbers(spark, d):
    p = table(spark, d, "ocr_pages").select("page_no", "work_family", "page_number").distinct()
    got = asof.neighbours(p, p.where("page_number is not null"), ["work_family"], "page_no", "page_number", Scratch(spark, "asof"))
    return asof.interpolate(got, "page_no", "number").select("page_no", F.round("number", 6).alias("number"))


@query("event_chain", """SELECT user_id, count(*) AS events, count(*) FILTER (prev = event_type) AS repeats, count(*) FILTER (ts < before) AS backward FROM (SELECT *, lag(event_type) OVER w AS prev, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY user_id""")
def event_chain(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").withColumn("prev", F.lag("event_type").over(w)).withColumn("before", F.lag("ts").over(w))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.expr("prev = event_type")).alias("repeats"), F.count_if(F.expr("ts < before")).alias("backward"))


@query("latest_per_user", """WITH m AS (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY ALL) SELECT m.user_id, m.event_type, max(e.value) AS value, count(DISTINCT e.value) > 1 AS ambiguous FROM m JOIN events e ON e.user_id = m.user_id AND e.event_type = m.event_type AND e.ts = m.ts GROUP BY ALL""")
def latest_per_user(spark, d):
    return review.latest(table(spark, d, "events"), ["user_id", "event_type"], "ts", ["value"]).select("user_id", "event_type", "value", "ambiguous")


@query("review_states", """WITH e AS (SELECT user_id % 500 AS page, 'r' || (user_id % 3) AS who, event_type AS after_, CASE WHEN value > 20 THEN 'verified' ELSE 'proposed' END AS decision, event_id FROM events), l AS (SELECT page, who, arg_max(after_, event_id) AS after_, arg_max(decision, event_id) AS decision FROM e GROUP BY ALL),
g AS (SELECT page, count(DISTINCT after_) AS texts, count(DISTINCT CASE WHEN decision = 'verified' THEN who END) AS v, count(DISTINCT who) AS n FROM l GROUP BY page) SELECT CASE WHEN texts > 1 THEN 'conflict' WHEN v >= 2 AND v = n THEN 'verified' ELSE 'pending' END AS state, count(*) AS pages FROM g GROUP BY 1""")
def review_states(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 500).alias("page_id"), F.concat(F.lit("r"), F.col("user_id") % 3).alias("reviewer"), F.col("event_type").alias("after"), F.when(F.col("value") > 20, "verified").otherwise("proposed").alias("decision"), "event_id")
    last = review.latest(e, ["page_id", "reviewer"], "event_id", ["after", "decision"])
    return review.adjudicate(last).groupBy("state").agg(F.count(F.lit(1)).alias("pages"))


@query("hourly_events", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(spark, d):
    got = workers.event_windows(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 hour")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("glyph_readings", """WITH u AS (SELECT DISTINCT spot_id, tesseract_js, gpt_4o_mini, qwen3_vl_4b, paddlevl_1_6, qwen3_vl_235b_api, gpt_5_4 FROM uffd_evidence), l AS (UNPIVOT u ON COLUMNS(* EXCLUDE spot_id) INTO NAME system VALUE reading)
SELECT system, reading, count(*) AS n FROM l GROUP BY ALL""")
def glyph_readings(spark, d):
    cols = ["tesseract_js", "gpt_4o_mini", "qwen3_vl_4b", "paddlevl_1_6", "qwen3_vl_235b_api", "gpt_5_4"]
    u = table(spark, d, "uffd_evidence").select("spot_id", *cols).distinct()
    return u.unpivot("spot_id", cols, "system", "reading").where("reading is not null").groupBy("system", "reading").agg(F.count(F.lit(1)).alias("n"))


@query("reading_order")
def reading_order(spark, d):
    rows = boxes(spark, d).where("size(bbox) = 4").select("page_id", "id", F.col("bbox").alias("box"))
    return layout.reading_order(rows)


@query("detection_matches")
def detection_matches(spark, d):
    rows = boxes(spark, d, "crop_bbox", "min_word_confidence").where("size(bbox) = 4 and size(crop_bbox) = 4")
    label = F.when(F.col("line_index") == 0, "head").otherwise("line").alias("label")
    found = rows.select("page_id", "id", label, F.col("crop_bbox").alias("box"), F.coalesce("min_word_confidence", F.lit(0.0)).alias("score"))
    return layout.match_detections(found, rows.select("page_id", label, F.col("bbox").alias("box")))


@query("consensus_boxes")
def consensus_boxes(spark, d):
    rows = boxes(spark, d, "crop_bbox", "min_word_confidence").where("size(bbox) = 4 and size(crop_bbox) = 4")
    score = F.coalesce("min_word_confidence", F.lit(0.0)).alias("score")
    one = lambda c, t: rows.select("page_id", F.lit(t).alias("teacher"), "id", F.lit("line").alias("label"), F.col(c).cast("array<double>").alias("box"), score)
    return layout.consensus(one("bbox", "a").union(one("crop_bbox", "b")), iou=0.3)


@query("table_similarity")
def table_similarity(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    html = n.groupBy("r_name").agg(F.concat(F.lit("<table>"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<tr>"), cell("n_name"), cell(F.col("n_nationkey").cast("string")), F.lit("</tr>")))), ""), F.lit("</table>")).alias("html"))
    return html.select("r_name", table_scores("html", F.replace("html", F.lit("A"), F.lit("O"))).alias("s")).select("r_name", "s.teds", "s.struct")


@query("box_hulls", f"""WITH {CURRENT} SELECT id, greatest(bbox[1] - 4, 0) AS left_, greatest(bbox[2] - 4, 0) AS top_, least(bbox[3] + 4, 2000) AS right_, least(bbox[4] + 4, 3000) AS bottom_ FROM cur""")
def box_hulls(spark, d):
    c = G.clamp(F.col("bbox"), 4, F.lit(2000), F.lit(3000))
    return boxes(spark, d).select("id", c[0].alias("left_"), c[1].alias("top_"), c[2].alias("right_"), c[3].alias("bottom_"))
