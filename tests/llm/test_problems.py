"""The eight problems on small cases, against brute force where there is one, on empty tables and on tables full of nulls."""

import random
import unicodedata
from collections import Counter, defaultdict

import pandas as pd
import pytest

from atrament.llm import consensus, groups, mixing, overlap, packing, pages, pairs, registry, sentences
from atrament.session import Scratch

FOUND = {"p1_found": ["page_no", "line_index", "defect"], "p2_found": ["response_id", "defect"], "p3_found": ["group_page", "page_id"], "p4_found": ["id_a", "id_b"], "p5_found": ["spot_id", "label"], "p8_found": ["doc_id", "start_char", "end_char"]}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_found_has_its_columns_and_no_repeats(spark, data, name):
    got = registry.queries()[name](spark, data)
    rows = [tuple(r) for r in got.collect()]
    assert got.columns == FOUND[name] and len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, empty, name):
    assert registry.queries()[name](spark, empty).count() <= (6 if name == "p5_annotators" else 1)


@pytest.mark.parametrize("name", sorted(FOUND) + ["p6_packed", "p7_selected", "p1_paragraphs"])
def test_null_tables(spark, nulls, name):
    rows = [tuple(r) for r in registry.queries()[name](spark, nulls).collect()]
    assert len(rows) == len(set(rows))


def test_groups_equal_union_find(spark, scratch):
    rng, rows = random.Random(3), []
    for i in range(300):
        rows.append((f"l{i}", f"p{rng.randrange(120):03}", rng.choice([None, f"Rod Ż-{rng.randrange(50)}", f"rod z{rng.randrange(50)}"]), rng.choice([None, None, f"c{rng.randrange(80)}"]), rng.choice(["train", " VAL", "test", None, "valid"]), i))
    df = spark.createDataFrame(rows, "id string, page_id string, work_family string, collection string, split string, ingested_at int")
    got = {r.page_id: (r.group_page, bin(r.splits).count("1")) for r in groups.page_groups(df, scratch).collect()}
    fold = lambda s: "".join(c for c in unicodedata.normalize("NFD", s.lower()) if c.isalnum())
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for _, p, w, c, _, _ in rows:
        find(p)
        for k in ([("w", fold(w))] if w else []) + ([("c", fold(c))] if c else []):
            parent[find(k)] = find(p)
    members, splits = defaultdict(list), defaultdict(set)
    for _, p, _, _, s, _ in rows:
        members[find(p)].append(p)
        if s:
            splits[find(p)].add({"valid": "val"}.get(s.strip().lower(), s.strip().lower()))
    assert got == {p: (min(members[find(p)]), len(splits[find(p)])) for _, p, *_ in rows}


def test_split_shares(spark, scratch):
    df = spark.createDataFrame([(f"g{i}", 1 + i % 7) for i in range(400)] + [("hot", 700)], "group_page string, weight bigint")
    goal = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], "split string, target_share double")
    rows = groups.assign(df, goal, scratch).collect()
    total = sum(r.weight for r in rows)
    share = Counter()
    for r in rows:
        share[r.split] += r.weight / total
    assert len(rows) == 401 and abs(share["train"] - 0.8) < 0.02 and abs(share["val"] - 0.1) < 0.02


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_overlap_recall(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfghklmnprstwz") + rng.choice("aeiouy") for _ in range(rng.randrange(2, 5)))
    texts = [" ".join(word() for _ in range(14)) for _ in range(150)]
    rows = [(f"a{i:03}", t, "train", "s", 1) for i, t in enumerate(texts)]
    for i, t in enumerate(texts):
        s = list(t)
        for at in rng.sample(range(len(s)), i % 12):
            s[at] = rng.choice("bcdfghk")
        rows.append((f"b{i:03}", "".join(s).upper(), rng.choice(["test", "valid"]), "s", 1))
    rows += [("c1", None, "test", "s", 1), ("c2", "krótki", "test", "s", 1), ("c3", "krótki", "train", "s", 1), ("c4", texts[0], None, "s", 1)]
    df = spark.createDataFrame(rows, "id string, reference string, split string, source_page string, ingested_at int")
    got = {(r.id_t, r.id_h) for r in overlap.overlaps(df, Scratch(spark, "t")).collect()}
    key = lambda t: "".join(c for c in t.lower() if c.isalnum())
    train, held = [(i, key(t)) for i, t, s, *_ in rows[:300] if s == "train"], [(i, key(t)) for i, t, s, *_ in rows[:300] if s != "train"]
    want = {(i, j) for i, a in train for j, b in held if abs(len(a) - len(b)) <= 12 and distance(a, b) * 100 <= 12 * max(len(a), len(b))}
    assert got <= want and len(got) >= 0.95 * len(want)


def _templates(spark, scratch, rows):
    """rows (output, prompt, category) to the openings of templates."""
    df = spark.createDataFrame([(pairs.opening(o), *rest) for o, *rest in rows], "opening string, prompt bigint, category string")
    return {r.opening for r in pairs.templates(df, scratch).collect()}


def test_templates_join_openings_that_are_alike(spark, scratch):
    """Each opening stands once, the rest of sixty words is the same; a chain whose ends are not alike is one cluster."""
    tail = " ".join(f"word{chr(97 + i // 8)}{chr(97 + i % 8)}" for i in range(50))
    kinds = ["question", "extract"]
    rows = [(f"we leave the page of {x} as it is {tail}", i, kinds[i % 2]) for i, x in enumerate(["jan", "anna", "piotr", "ewa"])]
    assert len(_templates(spark, scratch, rows)) == 4
    words = [f"w{chr(97 + i // 20)}{chr(97 + i % 20)}" for i in range(80)]
    chain = [" ".join(words[6 * i : 6 * i + 60]) for i in range(4)]
    p, q, r = (set(pairs.shingles(x).tolist()) for x in chain[:3])
    assert pairs._alike(p, q) and not pairs._alike(p, r)
    assert len(_templates(spark, scratch, [(x, i, kinds[i % 2]) for i, x in enumerate(chain)])) == 4


def test_templates_recur_over_prompts_and_kinds(spark, scratch):
    four = lambda text, prompts, kinds: [(text, i % prompts, kinds[i % len(kinds)]) for i in range(4)]
    rows = four("mi rifuzas tion. bonvolu sendi alian", 4, ["question", "repair_x"]) + four("mi rifuzas tion. dankon", 4, ["question", None])
    assert _templates(spark, scratch, rows + four("one prompt only", 1, ["question", "repair_x"]) + four("one kind only", 4, ["question"])) == {"mi rifuzas tion"} | {"mi rifuzas tion bonvolu sendi alian"} & {pairs.opening("mi rifuzas tion. bonvolu sendi alian")}
    assert _templates(spark, scratch, []) == set()


def test_refusals_come_from_templates_alone(spark, scratch, monkeypatch):
    """A language of no list: without the templates no refusal is left."""
    says = ["Ni ne povas fari tion.", "Bedaŭrinde ni ne povas fari tion."]
    rows = [(i, ["question", "repair_synthetic"][i % 2], f"Popraw błędy w wierszu:\nStary list numer {chr(97 + i)} leży.", says[i % 3 > 1], "ok") for i in range(12)]
    rows += [(20, "question", "O czym to?\nStary list.", "„Ni ne povas fari tion.” – pisze on i czyta dalej stary list.", "ok"), (21, "question", "O czym to?\nStary list.", "Ni ne povas fari tion.", "error")]
    df = spark.createDataFrame(rows, "response_id bigint, category string, input string, output string, status string").selectExpr("*", "cast(null as string) reference", "'stop' finish_reason", "cast(null as timestamp) received_at")
    docs = spark.createDataFrame([(1, "Stary list leży na stole. Pisarz czyta.", "pl")], "doc_id bigint, text string, lang string")
    refused = lambda: {r.response_id for r in pairs.judged(df, docs, scratch).where("defect = 'refusal'").collect()}
    assert refused() == set(range(12))
    monkeypatch.setattr(pairs, "PROMPTS", 100)
    assert refused() == set()


def test_clusters_of_openings_lose_few_pairs():
    """Recall of the bands against all pairs at the similarity asked for."""
    rng, near, met = random.Random(4), 0, 0
    for _ in range(600):
        a = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        b = list(a)
        b[rng.randrange(60)] = "x"
        x, y = " ".join(a), " ".join(b)
        if pairs._alike(set(pairs.shingles(x).tolist()), set(pairs.shingles(y).tolist())):
            near += 1
            (got,) = pairs._bands([pd.DataFrame({"id": [1, 2], "text": [x, y]})])
            met += bool(set(got.band[got.id == 1]) & set(got.band[got.id == 2]))
    assert near > 300 and met >= 0.98 * near


def test_instructions_and_copies_beyond_any_prefix():
    head = "Popraw błędy w wierszu: " * 30 + "\n"
    text = head + "Pi5arz czyta stary list w małej czytelni."
    assert cut_at(text)[-1] == len(head) and len(head) > 700
    assert see("question", text, "Pi5arz czyta stary list w małej czytelni.", known=[len(head)]) == "copy"
    judge = pairs.Judge(None)
    assert judge.asked("Przetłumacz " + "bardzo starannie " * 20 + "na czeski:") == "cs" and judge.asked("Przełóż") is None


def test_trigrams_more_frequent_than_texts_win_no_minimum():
    import numpy as np

    df = np.ones(overlap.BINS, np.int64)
    df[overlap.grams(["aaa"])[0]] = 1000
    coder = overlap.Coder(df, 100)
    coder(["aaaabcdefghijklmnoprst"])
    assert coder.draws.min() >= 0
    rest, _ = coder(["aaaabcdefghijklmnoprst", "aaaazyxwvutsrqponmlkji"])
    assert (rest[0] != rest[1]).all()


def test_overlap_finds_every_pair_at_the_border(spark):
    """Random letters at the largest distance leave many pairs without a common segment."""
    rng, rows, near = random.Random(17), [], set()
    word = lambda n: "".join(rng.choice("abcdefghijklmnoprstuwyz") for _ in range(n))
    for i in range(400):
        a = word(rng.choice([20, 23, 34, 60, 97, 130]))
        b = list(a)
        for j in rng.sample(range(len(a)), len(a) * 12 // 100):
            b[j] = rng.choice(["", "q", "x" + b[j]]) if i % 2 else rng.choice("vqx")
        b = "".join(b)
        rows += [(f"a{i}", "p", "train", a, 1), (f"b{i}", "p", "test", b, 1)]
        if len(b) >= 20 and distance(a, b) * 100 <= 12 * max(len(a), len(b)):
            near.add((f"a{i}", f"b{i}"))
    df = spark.createDataFrame(rows, "id string, source_page string, split string, reference string, ingested_at int")
    got = {(r.id_t, r.id_h) for r in overlap.overlaps(df, Scratch(spark, "t")).collect()}
    assert len(near) > 200 and got == near


def test_overlap_keeps_few_candidates_of_a_common_phrase(spark):
    """All texts hold one phrase and the same letters around it, shuffled: pairs met by the phrase are told apart before they are kept."""
    rng, letters, rows = random.Random(23), list("aabbccddeeffgghhiijjkkllmmnnoopprrssttuuwwyyzz"), []
    for i in range(300):
        rng.shuffle(letters)
        a = "".join(letters[:23]) + "ciagniesiegruntktoryzastawia" + "".join(letters[23:])
        rows += [(f"a{i}", "p", "train", a, 1)]
        rng.shuffle(letters)
        b = "".join(letters[:23]) + "ciagniesiegruntktoryzastawia" + "".join(letters[23:])
        rows += [(f"b{i}", "p", "test", a[:10] + "vxv" + a[13:60] + a[61:] if i % 10 == 0 else b, 1)]

    class Counted(Scratch):
        kept = 0

        def keep(self, df):
            out = super().keep(df)
            self.kept += out.count()
            return out

    scratch = Counted(spark, "t")
    df = spark.createDataFrame(rows, "id string, source_page string, split string, reference string, ingested_at int")
    got = {(r.id_t, r.id_h) for r in overlap.overlaps(df, scratch).collect()}
    assert got == {(f"a{i}", f"b{i}") for i in range(0, 300, 10)} and scratch.kept < 10 * len(rows)


def test_overlap_meets_pieces_of_any_batch(spark, monkeypatch):
    """A piece's rows may come in many batches, and its pairs in many chunks."""
    import numpy as np

    rng = random.Random(29)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(20, 40))) for _ in range(120)]
    train, held = texts[:60], texts[60:] + [t[:-1] + "d" for t in texts[:40]]
    frame = pd.DataFrame({"num": range(160), "text": train + held, "train": [True] * 60 + [False] * 100, "held": [False] * 60 + [True] * 100})
    counts = np.full(overlap.PIECE_BINS, 0.01, np.float32)
    spots = []
    for t in frame["text"]:
        a, lens = overlap._letters([t])
        q = int(overlap.piece_size(lens)[0])
        spots.append(overlap.rare_pieces(overlap._pieces(a, q), lens, q, counts)[0].astype(np.int32))
    frame["spots"] = [x[x >= 0] for x in spots]
    frame[list(overlap.BITS_OF)] = np.concatenate([overlap.letter_bits(overlap._letters(frame["text"])[0]), overlap.pair_bits(frame["text"])], axis=1)
    rows = pd.concat([r for part in range(overlap.ROUNDS) for r in overlap._rows_of_pieces(part)(iter([frame]))]).sort_values("key", kind="stable")

    def pairs(size):
        return {(x, y) for p in overlap._meet(rows.iloc[i : i + size] for i in range(0, len(rows), size)) for x, y in zip(p["num_t"], p["num_h"])}

    whole = pairs(len(rows))
    near = {(i, j) for i in range(60) for j in range(60, 160) if distance(train[i], held[j - 60]) * 100 <= 12 * max(len(train[i]), len(held[j - 60]))}
    monkeypatch.setattr(overlap, "TOGETHER", 5)
    monkeypatch.setattr(overlap, "AT_ONCE", 3)
    monkeypatch.setattr(overlap, "SLICE", 4)
    assert len(near) >= 40 and near <= whole and pairs(7) == whole


def test_consensus_labels():
    assert [consensus.clean(x) for x in (None, " ", "<empty>", "„a”", "(b)\n", "*c*", "ﻻ", "é", "​d", "'E'")] == [None, None, None, "a", "b", "c", "ﻻ", "é", "d", "E"]


def test_consensus_trusts_the_reliable(spark, scratch):
    rng, rows = random.Random(2), []
    truth = {}
    for i in range(400):
        t = truth[i] = rng.choice("abcdefgh")
        good = [t if rng.random() < 0.95 else rng.choice("abcdefgh") for _ in range(2)]
        bad = [rng.choice("abcdefgh") if rng.random() < 0.6 else t for _ in range(3)]
        rows.append((i, *good, *bad, 1))
    df = spark.createDataFrame(rows, "spot_id int, a string, b string, c string, d string, e string, collected_at int")
    found, people = consensus.consensus(df.union(df), ["a", "b", "c", "d", "e"], scratch)
    got = {r.spot_id: r.label for r in found.collect()}
    rel = {r.annotator: r.reliability for r in people.collect()}
    assert sum(got[i] == t for i, t in truth.items()) >= 385
    assert len(got) == 400 and min(rel["a"], rel["b"]) > max(rel["c"], rel["d"])


def test_consensus_tells_annotators_with_equal_answers_apart(spark, scratch):
    rows = [(i, *["a" if k == i % 5 else None for k in range(5)], 1) for i in range(40)] + [(99, None, "b", "b", None, "c", 1)]
    df = spark.createDataFrame(rows, "spot_id int, a string, b string, c string, d string, e string, collected_at int")
    found = consensus.consensus(df, ["a", "b", "c", "d", "e"], scratch)[0].collect()
    assert sorted(r.spot_id for r in found) == [*range(40), 99] and {r.label for r in found} == {"a", "b"}


def test_plan_fills_and_keeps_counts():
    rng = random.Random(1)
    for capacity, separator in ((50, 0), (128, 2), (512, 1)):
        counts = {n: rng.randrange(1, 60) for n in rng.sample(range(1, capacity + 1), 40)}
        used, ranks, places = defaultdict(list), defaultdict(int), set()
        for n, first, last, container, each, position in packing.plan(counts, capacity, separator):
            assert first == ranks[n]
            ranks[n] = last
            for r in range(first, last):
                c, p = container + (r - first) // each, position + (r - first) % each
                assert (c, p) not in places
                places.add((c, p))
                used[c].append(n)
        assert dict(ranks) == counts
        assert all(sum(x) + separator * (len(x) - 1) <= capacity for x in used.values())
        least = -(-sum((n + separator) * k for n, k in counts.items()) // (capacity + separator))
        assert len(used) <= 1.25 * least + 1


def test_packing_keeps_every_token(spark, scratch):
    sizes = spark.createDataFrame([(i, n) for i, n in enumerate([5, 5, 5, 70, 130, 0, 64, 1])], "doc_id bigint, n_tokens bigint")
    rows = packing.pack(sizes, 64, 1, scratch).collect()
    whole = Counter()
    for r in rows:
        whole[r.doc_id] += r.n_tokens
    assert whole == Counter({0: 5, 1: 5, 2: 5, 3: 70, 4: 130, 6: 64, 7: 1}) and {r.piece for r in rows if r.doc_id < 3} == {0}


def test_rake_holds_shares_and_caps():
    cells = {("a", "pl", "x"): 900, ("a", "en", "x"): 100, ("b", "pl", "y"): 50, ("b", "en", "x"): 10}
    factor, size = mixing.rake(cells, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 4})
    got = {s: sum(f * cells[c] for c, f in factor.items() if c[0] == s) / size for s in "ab"}
    assert size == 480 and abs(got["a"] - 0.5) < 1e-9 and abs(got["b"] - 0.5) < 1e-9 and max(f for c, f in factor.items() if c[0] == "b") <= 4 + 1e-9


def test_mixing_uses_a_text_no_more_than_allowed(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    cap = {(r.mix_id, r.source): r.max_repeats for r in spark.read.parquet(f"{data}/mix_targets.parquet").collect()}
    used = Counter()
    for r in mixing.p7_selected(spark, data).collect():
        used[r.mix_id, r.source, docs[r.doc_id]] += r.uses
    assert used and all(n <= cap[k[:2]] for k, n in used.items())


def units(text, lang="pl", model=None):
    model = model or {"*": {"abbr": {"r": 0.6, "prof": 0.0, "str": -1.0, "itd": 0.9, "dr": 0.0}, "known": {"pisarz": 1, "w": 1, "na": 1, "i": 1}, "ordinal": {"oktober"}}}
    return [text[a:b] for a, b in sentences.Cutter(model)(text, lang)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Pisarz czyta str. 5. Pisarz pisze.", ["Pisarz czyta str. 5.", "Pisarz pisze."]),
        ("Wg prof. Kota to nie e. Koniec!", ["Wg prof. Kota to nie e.", "Koniec!"]),
        ("W 1846 r. Kotowicz pisze. Zna list z 1846 r. Pisarz pije.", ["W 1846 r. Kotowicz pisze.", "Zna list z 1846 r.", "Pisarz pije."]),
        ("Jest dom.Pisarz ma plik a.png dziś.", ["Jest dom.", "Pisarz ma plik a.png dziś."]),
        ("„Czy to on?” – pyta pisarz. Tak.", ["„Czy to on?” – pyta pisarz.", "Tak."]),
        ("„Idzie. Wraca.” Koniec.", ["„Idzie.", "Wraca.”", "Koniec."]),
        ("Rozdział I\n\nPisarz pisze\ndalej.", ["Rozdział I", "Pisarz pisze\ndalej."]),
        ("Spis:\n1. pierwszy list\n2. drugi list", ["Spis:", "1. pierwszy list", "2. drugi list"]),
        ("Am 9. Oktober kam er. Ende.", ["Am 9. Oktober kam er.", "Ende."]),
        ("编辑清点。“校对员检查。”谁阅读？", ["编辑清点。", "“校对员检查。”", "谁阅读？"]),
        ("ครูเก็บเล่ม ผู้อ่านตรวจ", ["ครูเก็บเล่ม", "ผู้อ่านตรวจ"]),
        ("    ", []),
        ("", []),
    ],
)
def test_sentence_units(text, want):
    assert units(text) == want


def test_units_are_disjoint_and_cover_all_but_blanks(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect() if r.text}
    at = defaultdict(list)
    for r in sentences.p8_found(spark, data).collect():
        at[r.doc_id].append((r.start_char, r.end_char))
    for doc, text in texts.items():
        spans = sorted(at[doc])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        rest = "".join(text[a:b] for a, b in zip([0] + [e for _, e in spans], [s for s, _ in spans] + [len(text)], strict=True))
        assert not rest.strip()


def test_page_numbers_and_keys():
    assert 24 in pages.page_number("* 24 *") and 103 in pages.page_number("[1O3]") and 72 in pages.page_number("lxxii") and 145 in pages.page_number("[14?]") and not pages.page_number("Rozdział I")
    assert pages.line_key("ROCZNIKI GÓRNOWIDZKIE") == pages.line_key("ROCZNlKI GÓRNOWIDZKIE  — 57 —")


def test_misread_and_broken_words():
    w = pages.Words({"proboszcz": 900, "morgen": 200, "miasta": 800, "polsko-niemiecki": 40, "niemiecki": 30, "druk": 500, "drukarni": 300, "czytelni": 200, "w": 900, "na": 500})
    assert w.source("probos2cz")[0] == "proboszcz" and w.source("moigen")[0] == "morgen" and w.source("rniasta")[0] == "miasta" and w.source("drulc")[0] == "druk"
    assert w.source("druk") is None and w.source("Kotowicz") is None and w.source("51") is None
    assert pages.broken(w, "w dru-", "karni na")[0] and pages.broken(w, "w czy", "telni")[0] and not pages.broken(w, "druk polsko-", "niemiecki")[0] and not pages.broken(w, "druk", "na")[0]


def cut_at(text):
    return [at for _, at in pairs.cuts(text)]


def see(kind, text, out, finish="stop", template=False, known=None):
    judge = pairs.Judge(pairs.identify.Identifier({"pl": Counter({"a": 1}), "en": Counter({"b": 1})}))
    heads = ("Popraw błędy w wierszu:\n", "Odczytaj pola jako JSON:\n")
    known = [len(h) for h in heads if text.startswith(h)] if known is None else known
    return judge(kind, text, out, None, finish, "ok", template, cut_at(text), known)


def test_pairs_by_kind():
    line = "Popraw błędy w wierszu:\nPi5arz czyta stary list w małej czytelni."
    assert see("repair_synthetic", line, None) == "empty" and see("repair_synthetic", line, "```\n```") == "empty" and see("extract", line, "null") == "empty"
    assert see("repair_synthetic", line, "„Pi5arz czyta stary list w małej czytelni.”") == "copy" and see("repair_synthetic", line, line) == "copy"
    assert see("repair_synthetic", line, "Pisarz czyta stary list w małej czytelni.", "length") is None
    assert see("repair_synthetic", line, "Pisarz czyta stary li") == "truncated" and see("extract", "Odczytaj pola jako JSON:\nFaktura 5", '{"a": "b') == "truncated"
    assert see("question", "O czym to?\nStary list.", "Niestety nie mogę pomóc z tym tekstem.", template=True) == "refusal"
    assert see("repair_synthetic", "Popraw błędy w wierszu:\n„Nie mogę pom6c” – pisze on.", "„Nie mogę pomóc” – pisze on.") is None
    assert see("preserve_clean", "Stary list leży.", "Stary list leży.") is None


def test_paragraphs_join_broken_words(spark, scratch):
    line = "line_index int, raw_text string, confidence double, bbox array<int>"
    lines = [[(0, "NAGŁÓWEK DZIEŁA", 0.9, [90, 0, 9, 9]), (1, "Pierwszy akapit ma sło-", 0.9, [120, 0, 9, 9]), (2, "wo i koniec.", 0.9, [90, 0, 9, 9])], [(0, "NAGŁÓWEK DZIEŁA", 0.9, [90, 0, 9, 9]), (1, "ciąg dalszy.", 0.9, [90, 0, 9, 9]), (2, "Drugi akapit.", 0.9, [130, 0, 9, 9]), (3, "7", 0.9, [90, 0, 9, 9]), (4, "-", 0.9, None)]]
    df = spark.createDataFrame([(i, "w", 6 + i, x, None) for i, x in enumerate(lines)], f"page_no bigint, work_family string, page_number int, lines array<struct<{line.replace(' int', ':int').replace(' string', ':string').replace(' double', ':double').replace(' array', ':array')}>>, scanned_at timestamp")
    got = [r.text for r in pages.paragraphs(scratch.keep(pages.marked(df, scratch)), scratch).orderBy("page_no", "line_index").collect()]
    assert got[0].startswith("Pierwszy akapit ma słowo i koniec. ciąg dalszy.") and got[1].startswith("Drugi akapit.")


def test_pages_read_lines_and_words_of_any_length(spark, scratch):
    w = pages.Words({"konstantynopolitańczykowianeczka" * 2: 900, "proboszczmiastamorgenniemieckidrukarniczytelni": 900})
    assert w.source("konstantynopolitańczykowianeczka" + "konstantynopolitańczykowianec2ka") is not None
    assert w.source("pr0b0szczrniastam0rgenniemieckidrukarniczyte1ni")[0].startswith("proboszcz")  # five confusions in 46 letters
    head = "ROCZNIKI GÓRNOWIDZKIE " * 6 + "TOM DRUGI"  # 141 characters
    page = lambda i: [(0, head, 0.9, [9, 0, 9, 9]), *[(j, f"zwykły wiersz {chr(97 + i)}{chr(97 + j)} o niczym", 0.9, [9, 0, 9, 9]) for j in range(1, 12)]]
    df = spark.createDataFrame([(i, "dzieło", None, page(i), None) for i in range(8)], "page_no bigint, work_family string, page_number int, lines array<struct<line_index:int,raw_text:string,confidence:double,bbox:array<int>>>, scanned_at timestamp")
    assert {tuple(r.furniture) for r in pages.find_furniture(scratch.keep(pages.pages_of(df)), scratch).collect()} == {(0,)}


def test_paragraphs_of_pages_without_indents_stay_bounded(spark, scratch):
    page = lambda i: [(j, f"wiersz {i} {j}", 0.9, [90, 0, 9, 9]) for j in range(10)]
    df = spark.createDataFrame([(i, "w", None, page(i), None) for i in range(40)], "page_no bigint, work_family string, page_number int, lines array<struct<line_index:int,raw_text:string,confidence:double,bbox:array<int>>>, scanned_at timestamp")
    got = pages.paragraphs(scratch.keep(pages.marked(df, scratch)), scratch).collect()
    assert sum(r.lines for r in got) == 400 and max(r.lines for r in got) <= 20


def test_sentences_beyond_any_window():
    long = "pisarz " * 90
    assert units(f"Spis:\n1. {long}\n2. drugi list") == ["Spis:", f"1. {long}".strip(), "2. drugi list"]
    assert units("„Czy to on?”" + " " * 80 + "– pyta pisarz. Tak.")[1:] == ["Tak."]
    assert units("“校对员检查。”" + "编辑" * 20 + "问。谁阅读？")[1:] == ["谁阅读？"]
