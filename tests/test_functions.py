"""Functions and operators against known values and brute force."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from atrament.functions import geometry, text, trees, values
from atrament.functions.fold import fold, split_name
from atrament.operators import asof, contracts, corpus, graph, layout, review, scoring, select, similarity
from atrament.session import running_total


def one(spark, *cols, row=None):
    return tuple(spark.createDataFrame([row or (1,)], [f"c{i}" for i in range(len(row or (1,)))]).select(*[c.alias(f"x{i}") for i, c in enumerate(cols)]).first())


def test_dates(spark):
    given = ["13.10.2026", "13/10/2026", "13 października 2026 r.", "2026-10-13", "2026.10.13", "13 pazdziernika 2026", "13 Październik 2026", "31.02.2026", "13/10/26", None]
    assert one(spark, *[values.date_value(F.lit(x)) for x in given]) == ("2026-10-13",) * 7 + ("31.02.2026", "13/10/26", None)


def test_field_values(spark):
    v = lambda kind, x: values.field_value(F.lit(x), F.lit(kind))
    got = one(spark, v("text", "„Ala”  MA\t kota"), v("name", 'ZAKŁAD "GÓRNIK" Sp. z o.o.'), v("address", "ul. Marszałkowska 1A, 00-001 Warszawa"), v("nip", "123-456-78 90"), v("nip", "123"), v("money", "100 EUR"), v("text", ""))
    assert got == ('"ala" ma kota', 'zakład "górnik" sp. z o.o.', "ul marszałkowska 1a 00-001 warszawa", "1234567890", "123", "100 eur", "")


def test_noise_and_repetition(spark):
    got = one(spark, text.noise(F.lit("ul. A7 nr B12 pokój C3")), text.noise(F.lit(" \u2003")), text.noise(F.lit("xkcd brzdęk")), text.noise(F.lit("@@@@ abcdefghijkl")))
    assert got[:2] == (0.0, 1.0) and got[2] == 1.0 and got[3] == 1.0
    flags = lambda t: one(spark, *text.repetition(F.lit(t)).values())
    assert flags(" " * 70) == (False, False, False) and flags("a" * 64) == (True, False, False) and flags("la, " * 32) == (False, True, False) and flags(" x\n\nx\r\nx \nx") == (False, False, True)
    assert one(spark, text.sentence_ok(F.lit("„Ala” „ma” „kota” i psa w domu.")), text.map_glyphs(F.lit("ab"), {"a": "b", "b": "cc"}), text.payload_json(F.lit('x {"a": {"b": {"c": {"d": [{"e": "}"}]}}}} y'))) == (True, "bcc", '{"a": {"b": {"c": {"d": [{"e": "}"}]}}}}')


def test_money(spark):
    given = {"1 234,56 zł": "1234.56", "12,500": "12500", "1234,567": "1234.567", "1 234,-": "1234", "-0,00 zł": "0", "1.234,50": "1234.5", "1,234,567": "1234567", "0,5": "0.5", "-3,10 zł": "-3.1", "bez kwoty": "bez kwoty", "007": "7"}
    assert one(spark, *[values.money_value(F.lit(x)) for x in given]) == tuple(given.values())


def test_digits_and_verdicts(spark):
    assert one(spark, values.digits_value(F.lit("123-456-78-90"), 10), values.digits_value(F.lit("12-3"), 10)) == ("1234567890", "12-3")
    v = lambda a, b: values.verdict(F.lit(a), F.lit(b))
    assert one(spark, v("a", "a"), v("a", "b"), v("a", None), v("", "b"), v(None, "")) == ("match", "mismatch", "missing", "spurious", "absent")
    assert one(spark, values.check_digit(F.lit("526104082"), values.NIP_WEIGHTS, "nip"), values.check_digit(F.lit("4405140135"), values.PESEL_WEIGHTS, "pesel")) == (8, 9)


def test_index_percentile(spark):
    arr = F.array(*[F.lit(x) for x in (9, 1, 10, 2)])
    assert one(spark, values.index_percentile(arr, 0.5), values.index_percentile(arr, 0.99), values.index_percentile(arr, 0.0)) == (9, 10, 1)


def test_cells_round_trip(spark):
    given = ["a\tb", "a\\tb", "x\ny\r", "\\", "\\\\n", "zwykły tekst"]
    assert one(spark, *[text.unescape_cell(text.escape_cell(F.lit(x))) for x in given]) == tuple(given)
    with pytest.raises(Exception, match="unknown escape"):
        one(spark, text.unescape_cell(F.lit("a\\x")))


def test_text_functions(spark):
    assert one(spark, text.collapse(F.lit("  a  b\tc\n")), text.normalize_v1(F.lit("„a” ‘b’")), text.replace_once(F.lit("a b a"), F.lit("b"), F.lit("c")), text.replace_once(F.lit("a b a"), F.lit("a"), F.lit("c"))) == ("a b c", "\"a\" 'b'", "a c a", None)
    assert one(spark, text.payload_text(F.lit("oto:\n```json\n{}\n```")), text.payload_table(F.lit("<table>1</table><table>2</table>"), 2), text.payload_json(F.lit('x {"a": {"b": 1}} y'))) == ("{}", "<table>2</table>", '{"a": {"b": 1}}')
    assert one(spark, text.strip_tags(F.lit("<p>A &amp; B</p><script>x</script><div>C<br>D</div>"))) == ("A & B\nC\nD",)
    assert one(spark, text.longest_run(F.array(*[F.lit(x) for x in "aabbbc"])), F.size(text.shingles(text.words(F.lit("a b c d")), 3)), F.size(text.shingles(text.words(F.lit("a b")), 3))) == (3, 2, 1)
    assert one(spark, text.low_confidence(F.lit(float("nan")), 0.5), text.low_confidence(F.lit(0.1), 0.5), text.low_confidence(F.lit(None).cast("double"), 0.5)) == (False, True, False)
    assert one(spark, text.split_sentences(F.lit("A b. C d! E")), text.first_reason((F.lit(None).cast("boolean"), "x"), (F.lit(True), "y"))) == (["A b.", "C d!", "E"], "y")
    assert one(spark, fold(F.lit(" Żółć–Œ\u200b 5!")), split_name(F.lit(" VALID\n")), split_name(F.lit("dev"))) == ("zolcœ5", "val", None)


def test_trees():
    t = lambda cell: f"<table><tr><td>{cell}</td></tr></table>"
    assert trees.table_similarity(t("Ala"), t("Ola")) == pytest.approx(11 / 12) and trees.table_similarity(t("Ala"), t("Ola"), True) == 1
    assert trees.table_similarity(t("Ala"), "<table><tr><td>Ala</td></tr><tr><td>b</td></tr></table>") == pytest.approx(2 / 3)
    assert trees.table_similarity(t("a"), "<table><tr><th>a</th></tr></table>") == 0.75 and trees.table_similarity(t("a"), '<table><tr><td colspan="2">a</td></tr></table>') == 0.75
    assert trees.table_similarity(None, "") == 1 and trees.table_similarity(t("a"), "") == 0


def test_tree_distance_equals_mapping_search():
    rng = random.Random(4)

    def grow(n):
        nodes = [[rng.choice("ab"), (1, 1), "", []]]
        for _ in range(n - 1):
            child = [rng.choice("ab"), (1, 1), "", []]
            rng.choice(nodes)[3].append(child)
            nodes.append(child)
        return nodes[0]

    def size(f):
        return sum(1 + size(x[3]) for x in f)

    def forest(a, b):
        if not a or not b:
            return size(a) + size(b)
        x, y = a[-1], b[-1]
        return min(forest(a[:-1] + x[3], b) + 1, forest(a, b[:-1] + y[3]) + 1, forest(a[:-1], b[:-1]) + forest(x[3], y[3]) + (x[0] != y[0]))

    for _ in range(40):
        a, b = grow(rng.randrange(1, 6)), grow(rng.randrange(1, 6))
        assert trees.tree_distance(a, b, lambda p, q: float(p[0] != q[0])) == forest([a], [b])


def test_alignment_and_outline():
    assert [o for o, *_ in trees.edit_ops("kot", "kat")] == ["match", "replace", "match"] and trees.edit_distance("żółw", "zolw") == 3
    assert [trees.error_class(*x) for x in (("a", "A"), ("ł", "l"), ("s", "ſ"), (",", "."), ("a", "b"))] == ["case_only", "other", "long_s_or_s", "punctuation", "other"]
    assert [trees.error_class(*x) for x in (("ó", "o"), ("s", "f"), (".", "a"), (" ", ""), ("\ue000", "a"), ("a", "\ue000"))] == ["diacritic", "long_s_or_s", "punctuation", "whitespace", "private_use_reference", "other"]
    assert trees.outline("# A ##\n#\nx\n`y`\n\n- „b”\n1. c") == [("h1", "A ##"), ("p", "#"), ("p", "x"), ("p", "y"), ("li", '"b"'), ("li", "c")] and trees.outline_similarity("", "") == 1


def test_tables_in_cells():
    inner = "<table><tr><td>{}</td></tr></table>"
    outer = lambda text, cell: f"<table><tr><td>{text}{inner.format(cell)}</td><td></td></tr></table>"
    assert trees.table_similarity(outer("x", "a"), outer("y", "a")) == 1 and trees.table_similarity(outer("x", "a"), outer("x", "b")) < 1
    assert trees.table_rows.plain(pd.Series([outer("x", "a"), "<table><tr><td> </td></tr></table>", None])).tolist() == [["x a"], [], []]


def test_contained_pairs_equal_all_pairs(spark):
    rng = random.Random(5)
    sets = [sorted({rng.randrange(25) for _ in range(rng.randrange(1, 12))}) for _ in range(90)]
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in enumerate(sets)], "a int, t array<string>")
    got = {(r.a, r.b) for r in similarity.contained_pairs(df, df.withColumnRenamed("a", "b"), "t", 0.7).collect()}
    assert got == {(i, j) for i in range(90) for j in range(90) if i != j and len(set(sets[i]) & set(sets[j])) >= 0.7 * min(len(sets[i]), len(sets[j])) - 1e-9}


def test_hamming_candidates_are_few(spark):
    """Of unrelated hashes few share a chunk with at most one bit turned."""
    rng = random.Random(1)
    n, chunk = 2000, 16
    bits = [rng.getrandbits(64) for _ in range(n)]
    met = 0
    for i in range(4):
        seen = {}
        for b in bits:
            seen[b >> (chunk * i) & 0xFFFF] = seen.get(b >> (chunk * i) & 0xFFFF, 0) + 1
        met += sum(seen.get((b >> (chunk * i) & 0xFFFF) ^ m, 0) for b in bits for m in (0, *(1 << k for k in range(chunk))))
    assert met <= 0.05 * n * n


def test_bootstrap_weights_and_interval(spark):
    w = scoring.poisson_weights(np.arange(4000), np.arange(50))
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
    df = spark.createDataFrame([(i, 5, 5 - (i % 3 > 0), 100) for i in range(300)], "key bigint, a bigint, b bigint, chars bigint")
    r = scoring.bootstrap(df, 500).first()
    assert abs(r.change + 2 / 300) < 1e-9 and r.low < r.change < r.high < 0 and r.share_better == 1


def test_protected_selection(spark):
    rows = [("base", d, 0.10, 0.2, 5, 1) for d in ("old", "new", "combined")] + [("x", "old", 0.08, 0.2, 5, 1), ("x", "new", 0.10, 0.2, 5, 1), ("x", "combined", 0.09, 0.2, 5, 1)] + [("y", "old", 0.01, 0.2, 5, 2), ("y", "new", 0.11, 0.2, 5, 1), ("y", "combined", 0.05, 0.2, 5, 1)]
    df = spark.createDataFrame(rows, "name string, domain string, cer double, wer double, lines int, replacement_characters int")
    got = {r.name: (r.reasons, r.chosen) for r in scoring.protected_selection(df, "base", "old", "new").collect()}
    assert got == {"x": ("", True), "y": ("new:cer_regression,old:replacement_characters", False)}


def test_geometry(spark):
    box = lambda *b: F.array(*[F.lit(x) for x in b])
    a, b = box(0, 0, 10, 10), box(5, 0, 15, 10)
    assert one(spark, geometry.iou(a, b), geometry.containment(a, box(2, 2, 4, 4)), geometry.polygon_box(F.lit("1,2 5,0 3,9")), geometry.box_ok(box(0, 0, 5, 5), F.lit(5), F.lit(4))) == (pytest.approx(1 / 3), 1.0, [1, 0, 5, 9], False)
    turned, overlap = one(spark, geometry.rotate_box(box(0, 0, 10, 2), F.lit(90.0), F.lit(0), F.lit(0)), geometry.normal_overlap(box(0, 0, 9, 4), box(0, 6, 9, 9), F.lit(0.0)))
    assert all(abs(x - y) <= 1 for x, y in zip(turned, [-2, 0, 0, 10], strict=True)) and overlap == -2.0
    assert one(spark, geometry.sign_bits(F.array(F.lit(1.0), F.lit(-1.0), F.lit(2.0))), geometry.hamming(F.lit(5).cast("bigint"), F.lit(6).cast("bigint"))) == (5, 2)


def test_hamming_pairs_equal_all_pairs(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(63) for _ in range(30)]
    bits = base + [b ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(8))) for b in base]
    df = spark.createDataFrame(list(enumerate(bits)), "a int, h bigint")
    got = {(r.a, r.b) for r in similarity.hamming_pairs(df, df.withColumnRenamed("a", "b"), "h", 6).where("a < b").collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if bin(bits[i] ^ bits[j]).count("1") <= 6}


def test_prefix_pairs_equal_all_pairs(spark):
    rng = random.Random(8)
    sets = [sorted({rng.randrange(30) for _ in range(rng.randrange(1, 12))}) for _ in range(120)]
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in enumerate(sets)], "k int, t array<string>")
    got = {(r.a, r.b) for r in similarity.prefix_pairs(df, "k", F.col("t"), 0.6).collect()}
    assert got == {(i, j) for i in range(120) for j in range(i + 1, 120) if len(set(sets[i]) & set(sets[j])) >= 0.6 * len(set(sets[i]) | set(sets[j]))}


def test_components_and_running_total(spark, scratch):
    rng = random.Random(6)
    edges = [(f"v{rng.randrange(90)}", f"v{rng.randrange(90)}") for _ in range(70)] + [(None, "v1")]
    got = {r.v: r.root for r in graph.components(spark.createDataFrame(edges, "u string, v string"), scratch).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges[:-1]:
        parent[find(u)] = find(v)
    seen = {x for u, v in edges[:-1] if u != v for x in (u, v)}
    assert set(got) == seen and all((got[x] == got[y]) == (find(x) == find(y)) for x in seen for y in seen)
    df = spark.createDataFrame([(i, i % 5) for i in range(50)], "k bigint, w bigint")
    rows = running_total(df, [F.col("k")], "w", "before", scratch).orderBy("k").collect()
    assert [r.before for r in rows] == [sum(j % 5 for j in range(i)) for i in range(50)]


def test_contracts(spark):
    ref = spark.createDataFrame([("a",), ("b",)], "id string")
    pred = spark.createDataFrame([("a", "ok", "x", 1.0), ("a", "ok", "x", -1.0), ("c", "error", "y", None)], "id string, status string, text string, elapsed_seconds double")
    got = {(r.rule, r.key) for r in contracts.submission(ref, pred, "text").collect()}
    assert got == {("unique_key", "a"), ("missing", "b"), ("unknown", "c"), ("error_payload", "c"), ("finite:elapsed_seconds", "a")}
    with pytest.raises(ValueError, match="unique_key a"):
        contracts.gate(contracts.unique_key(pred, "id"))
    assert contracts.exact_columns(pred, {"id", "status"}) == ["elapsed_seconds", "text"]
    assert one(spark, *[contracts.safe_path(F.lit(x)) for x in ("a/b.png", "../a", "/a", "a/../b", "C:\\a", "")]) == (True, False, False, False, False, False)


def test_scoring(spark):
    ref = spark.createDataFrame([("1", "ala ma"), ("2", "kot"), ("3", "")], "id string, text string")
    pred = spark.createDataFrame([("1", "ok", "ala na"), ("2", "error", "kot"), ("3", "ok", "")], "id string, status string, out string")
    r = scoring.error_rates(scoring.with_edits(scoring.scored_join(ref, pred, "id", "text", "out"), "text"), [[]]).first()
    assert (r.rows, r.failed, r.char_edits, r.chars, r.word_edits, r.words) == (3, 1, 4, 9, 2, 3)
    assert scoring.composite({"cer": 0.1, "teds": 0.7, "f1": None}) == pytest.approx(0.8) and scoring.composite({}) is None
    gates = spark.createDataFrame([("x", -0.1, 0.005), ("y", 0.1, 0.0)], "name string, hist double, plain double")
    assert {r.name: r.promoted for r in scoring.promotion(gates, ["hist", "plain"], {"plain": 0.01}).collect()} == {"x": True, "y": False}


def test_layout(spark):
    det = spark.createDataFrame([("p", "t1", "1", "a", [0, 0, 10, 10], 0.9), ("p", "t2", "2", "a", [0, 0, 12, 10], 0.7), ("p", "t3", "3", "a", [50, 50, 60, 60], 0.5)], "page_id string, teacher string, id string, label string, box array<int>, score double")
    got = sorted((r.accepted, r.box, r.teachers) for r in layout.consensus(det).collect())
    assert got == [(False, [50, 50, 60, 60], ["t3"]), (True, [0, 0, 11, 10], ["t1", "t2"])]
    m = layout.match_detections(det, spark.createDataFrame([("p", "a", [0, 0, 10, 10])], "page_id string, label string, box array<int>")).first()
    assert (m.tp, m.fp, m.fn) == (1, 2, 0)
    two = spark.createDataFrame([("p", "head", [0, 0, 100, 10]), ("p", "r1", [55, 20, 100, 30]), ("p", "l1", [0, 20, 45, 30]), ("p", "l2", [0, 40, 45, 50])], "page_id string, id string, box array<int>")
    assert [r.id for r in layout.reading_order(two).orderBy("place").collect()] == ["head", "l1", "l2", "r1"]
    boxes = spark.createDataFrame([("p", [0, 0, 4, 4]), ("p", [90, 90, 95, 95])], "page_id string, box array<int>")
    regions = spark.createDataFrame([("p", 0, [50, 50, 80, 80]), ("p", 1, [0, 0, 9, 9])], "page_id string, region_index int, region_box array<int>")
    assert sorted(r.region_index for r in layout.assign_regions(boxes, regions).collect()) == [0, 1]
    assert one(spark, layout.occurrences(F.lit("kot (a)"), F.lit("kot (a), xkot (a) kot (a)"))) == (2,)


def test_review(spark):
    ev = spark.createDataFrame([("p", 1, "t0", "t1", 1, "t0"), ("p", 2, "t1", "t2", 2, "t0"), ("p", 3, "t0", "t3", 1, "t0")], "page string, seq int, before string, after string, timestamp int, original string")
    assert [r.seq for r in review.chain_breaks(ev, "page", ["seq"]).collect()] == [3]
    d = spark.createDataFrame([("a", "X ", "t", "verified"), ("a", "y", "t", "verified"), ("b", "x", "t", "verified"), ("b", "X", "u", "verified"), ("c", "x", "t", "verified"), ("c", "y", "t", "proposed")], "page_id string, reviewer string, after string, decision string").withColumn("ambiguous", F.lit(False))
    assert {r.page_id: r.state for r in review.adjudicate(d).collect()} == {"a": "verified", "b": "conflict", "c": "pending"}


def test_select_and_asof(spark, scratch):
    df = spark.createDataFrame([(f"g{i % 3}", i) for i in range(30)], "g string, k int")
    got = [r.g for r in select.round_robin(df, "g", "s", "k", 6).collect()]
    assert len(set(got[:3])) == 3 and got[:3] == got[3:]
    rows = spark.createDataFrame([("w", 5), ("w", 1), ("w", 20)], "w string, at int")
    anchors = spark.createDataFrame([("w", 2, 20.0), ("w", 8, 80.0)], "w string, at int, v double")
    out = asof.interpolate(asof.neighbours(rows, anchors, ["w"], "at", "v", scratch), "at", "x")
    assert {r.at: r.x for r in out.collect()} == {5: 50.0, 1: 20.0, 20: 80.0}


def test_coco_and_positions(spark, scratch):
    objects = spark.createDataFrame([("p2", "b", [0, 0, 4, 4]), ("p1", "a", [1, 1, 3, 5])], "page_id string, label string, box array<int>")
    images, notes, categories = layout.coco(objects, spark.createDataFrame([("p1", "f1", 9, 9), ("p2", "f2", 9, 9)], "page_id string, file_name string, width int, height int"), scratch)
    assert [(r.id, r.image_id, r.category_id, r.bbox) for r in notes.orderBy("id").collect()] == [(1, 1, 1, [1, 1, 2, 4]), (2, 2, 2, [0, 0, 4, 4])]
    a, b = spark.createDataFrame([(3,), (1,)], "k int"), spark.createDataFrame([(7,), (9,)], "k int")
    assert sorted((r.a.k, r.b.k) for r in corpus.positional(a, b, ["k"], scratch).collect()) == [(1, 7), (3, 9)]
    with pytest.raises(Exception, match="differ"):
        corpus.positional(a, b.limit(1), ["k"], scratch).collect()


def test_corpus(spark):
    new = spark.createDataFrame([("n1", "o1", "x")], "id string, parent_id string, text string")
    old = spark.createDataFrame([("o1", "y"), ("o2", "z")], "id string, text string")
    assert {r.root_id: r.text for r in corpus.merge_pools({"old": old, "new": new}, ["old", "new"]).collect()} == {"o1": "x", "o2": "z"}
    pages = spark.createDataFrame([("a", "train", "i", None), ("b", "test", "i", "d"), ("c", "val", "j", "d")], "id string, split string, image_sha256 string, document_id string")
    assert {(r.a, r.b): r.reasons for r in corpus.split_reasons(pages).collect()} == {("a", "b"): ["image"], ("b", "c"): ["document"]}
    kept, rest = corpus.route_labels(spark.createDataFrame([("Text-Block",), ("blot",)], "label string"), {"text block": "text"})
    assert kept.first().canonical == "text" and rest.first().label == "blot"
    assert corpus.disjoint_subset([("a", 4, frozenset("x")), ("b", 6, frozenset("xy")), ("c", 9, frozenset("y"))], 6, frozenset("xy")) == ("b",)
    bad = corpus.recompute_audit(spark.createDataFrame([("m", 0.1), ("n", 0.2)], "k string, cer double"), spark.createDataFrame([("m", 0.1), ("n", 0.3)], "k string, cer double"), ["k"], ["cer"])
    assert [r.k for r in bad.collect()] == ["n"]
    assert one(spark, corpus.accept_correction(F.lit("a\nb"), F.lit("c")), corpus.mean_probability(F.array(F.lit(1), F.lit(2)), F.array(F.lit(0.5), F.lit(0.9)), [2])) == ("a\nb", 0.5)


def test_json_is_sorted(spark):
    from atrament.sources.writers import sorted_json

    assert json.loads(one(spark, sorted_json(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))))[0]) == {"a": "2", "b": "1"}
