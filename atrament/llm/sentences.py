"""Problem 8: sentence boundaries across languages and scripts.

Method: unsupervised statistics per language, then a decision for each period. One pass counts word types before periods,
in lower case, at sure sentence starts and after ordinal numbers, and pairs (type before a period, capitalised successor).
Log-likelihood ratios over all documents give abbreviations (with the usual factors for length, inner periods and plain
use; the plain-use factor takes the rate instead of the count, so that it means the same at every size), collocations of
ordinal numbers, and sentence starters. For an abbreviation the share of ordinary words among its capitalised successors
tells whether it tends to end sentences. The second pass classifies every period with these tables, and treats other
marks, quotations with reporting clauses, list entries, headings, wrapped lines and scripts without marks by rule.

Abbreviations, starters and ordinal collocations of any frequency count, as the ratios alone decide. Of ordinary words those
with at least LEAST of a language's tokens are broadcast, at most 1 / LEAST.

Defined cases: null, empty and blank texts have no unit; repeated rows of a doc_id give their units once; a null doc_id
is ignored; long texts are cut whole; empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atrament.llm.languages import language
from atrament.session import Scratch, table

LEAST = 1e-6
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 30.0

#: Marks that end sentences, closers and openers, scripts written without them, words of reporting clauses.
MARKS = ".!?…؟।॥。！？｡۔։።"
WIDE = "。！？｡"
OPEN, CLOSE = "([{（【「『‹⟨", ")]}）】」』›⟩’"
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "「": "」", "『": "』", "‹": "›", "⟨": "⟩"}
UNMARKED = r"฀-໿က-႟ក-៿"
REPORT = {
    "cjk": re.compile(r"[^。！？\n]*(?:问|说|道|答|喊|叫|写|問|說|寫|叫ぶ|言う|言った|聞く|聞いた)[。！？]"),
    "と": re.compile(r"と"),
    "other": re.compile(r"[\s,،–—-]*(?:هكذا|يسأل|تسأل|سأل|يقول|تقول|قال|يكتب|[^\s।.!?]+(?:\s[^\s।.!?]+)*?\s(?:पूछता|पूछती|पूछा|कहता|कहती|कहा|बोला|बोली|लिखता|लिखती)|(?:पूछता|पूछती|कहता|कहती))"),
}

_TOKEN = regex.compile(r"\d+(?:[.,:/]\d+)*|\p{L}[\p{L}\p{M}]*(?:[.'’\-‐]\p{L}[\p{L}\p{M}]*)*")
_CLUSTER = re.compile(f"[{re.escape(MARKS)}]+")
_BREAK = re.compile(r"\s*?(?:\r\n|[\n\r\x0b\x0c\x85  ])\s*")
_LINE_END = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_MARKER = re.compile(r"(?:([•▪◦‣·*]|[-–—])|\(?(\d{1,3})[.)、]|[a-z][.)])[ \t ]*(?=\S)")
_QUOTE = re.compile(r"[\"„“”«»()\[\]{}（）【】「」『』‹›⟨⟩]|\n\s*\n")
_UNMARKED_GAP = re.compile(rf"(?<=[{UNMARKED}\d%.])[^\S\n\r\x0b\x0c\x85  ]+(?=\S)")
_HAS_UNMARKED = re.compile(f"[{UNMARKED}]")
_BEFORE = regex.compile(r"(?:\d+(?:[.,:/]\d+)*|\p{L}[\p{L}\p{M}]*(?:[.'’\-‐]\p{L}[\p{L}\p{M}]*)*)\Z")
_ROMAN = re.compile(r"[IVXLCDM]+\Z")
_NUMBERED = re.compile(r"[^\W\d_A-Z]\.\s*\Z")
_AHEAD, _SOLID = re.compile(r"[\s,–—-]*"), re.compile(r"\S*")
_BLANK_LINE = re.compile(r"\n\s*\n")


def count_types(batches):
    """Rows (lang, a, b, kind, n): p, n: type a before a period or not; l, u, s, o: a in lower case, capitalised inside a
    sentence, at a sure start, after an ordinal number; f: a before a period and a blank, then b, capitalised."""
    for batch in batches:
        got: Counter = Counter()
        for lang, text in zip(batch["language"], batch["text"], strict=True):
            before, before_end, dotted, since = "", 0, False, 0
            for m in _TOKEN.finditer(text):
                word = m[0]
                key, num = word.lower(), word[0].isdigit()
                gap = text[before_end : m.start()]
                period = text.startswith(".", m.end()) and not text.startswith("..", m.end())
                hard = not before or "\n\n" in gap or "!" in gap or "?" in gap or "؟" in gap
                if not num:
                    got[lang, key, "", "p" if period else "n"] += 1
                    cap = word[0].isupper()
                    if not cap:
                        got[lang, key, "", "l"] += 1
                    elif dotted and before[0].isdigit() and not hard:
                        got[lang, key, "", "o"] += 1
                    elif hard or dotted and len(before) > 4 and before.islower():
                        got[lang, key, "", "s"] += 1
                    elif not dotted and not _LINE_END.search(gap) and not any(c in "„“\"«»(" for c in gap):
                        got[lang, key, "", "u"] += 1
                    if cap and dotted and not before[0].isdigit() and since > 4 and len(gap) > 1:
                        got[lang, before.lower(), key, "f"] += 1
                if hard or dotted and len(before) > 4 and before.islower():
                    since = 0
                since += 1
                before, before_end, dotted = word, m.end(), period
        yield pd.DataFrame([(*k, n) for k, n in got.items()], columns=["lang", "a", "b", "kind", "n"])


def _log_l(k: Column, n: Column, p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return k * F.log(p) + (n - k) * F.log(1 - p)


def ratio(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Dunning's log-likelihood ratio of two rates, negative where the first is not the larger."""
    p1, p2, p = k1 / n1, k2 / F.greatest(n2, F.lit(1)), (k1 + k2) / (n1 + n2)
    g = 2 * (_log_l(k1, n1, p1) + _log_l(k2, n2, p2) - _log_l(k1, n1, p) - _log_l(k2, n2, p))
    return F.when(p1 > p2, g).otherwise(-g)


def learn(docs: DataFrame, scratch: Scratch) -> dict[str, dict]:
    """docs (language, text) to the tables of each language, and of all together under ``*``."""
    raw = docs.mapInPandas(count_types, "lang string, a string, b string, kind string, n bigint").groupBy("lang", "a", "b", "kind").agg(F.sum("n").alias("n"))
    raw = scratch.keep(raw)
    types = raw.where("kind <> 'f'").groupBy("lang", "a").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).cast("double").alias(k) for k in "pnluso"])
    both = types.union(types.groupBy(F.lit("*").alias("lang"), "a").agg(*[F.sum(k).alias(k) for k in "pnluso"]))
    both = scratch.keep(both.withColumn("c", F.col("p") + F.col("n")))
    totals = both.groupBy("lang").agg(F.sum("c").alias("all_c"), F.sum("p").alias("all_p"), F.sum("s").alias("all_s"), F.sum("o").alias("all_o"))
    t = both.join(F.broadcast(totals), "lang")  # a row per language
    size = F.greatest(F.char_length(F.replace("a", F.lit("."), F.lit(""))), F.lit(1))
    dunning = -2 * (_log_l(F.col("p"), F.col("c"), F.col("all_p") / F.col("all_c")) - _log_l(F.col("p"), F.col("c"), F.lit(0.99)))
    score = dunning * F.exp(-size) * (1 + F.char_length("a") - F.char_length(F.replace("a", F.lit("."), F.lit("")))) * F.pow(size + 1, -10 * F.col("n") / F.col("c"))
    start = ratio(F.col("s"), F.col("c"), F.col("all_s") - F.col("s"), F.col("all_c") - F.col("c"))
    ordinal = ratio(F.col("o"), F.col("c"), F.col("all_o") - F.col("o"), F.col("all_c") - F.col("c"))
    floor = LEAST * F.col("all_c")
    t = t.select(
        "lang", "a", (F.col("l") / F.col("all_c")).alias("rate"),
        ((score >= ABBREVIATION) & (F.col("p") >= 2)).alias("abbr"),
        ((F.col("l") >= F.greatest(floor, F.lit(2))) & (F.col("l") >= 0.05 * F.col("c"))).alias("common"),
        ((start >= STARTER) & (F.col("u") <= 0.1 * F.col("s"))).alias("starter"),
        ((ordinal >= COLLOCATION) & (F.col("o") >= 0.3 * F.col("c"))).alias("ordinal"),
    )
    t = scratch.keep(t.where("abbr or common or starter or ordinal"))
    pairs = raw.where("kind = 'f'").select("lang", "a", "b", "n")
    pairs = pairs.union(pairs.groupBy(F.lit("*").alias("lang"), "a", "b").agg(F.sum("n").alias("n")))
    pairs = pairs.join(t.where("abbr").select("lang", "a"), ["lang", "a"]).join(t.where("common or starter").select("lang", F.col("a").alias("b"), F.lit(1).alias("known")), ["lang", "b"], "left")
    ends = pairs.groupBy("lang", "a").agg((F.sum(F.col("n") * F.coalesce("known", F.lit(0))) / F.sum("n")).alias("ends"))
    model: dict[str, dict] = {}
    for r in t.join(ends, ["lang", "a"], "left").toLocalIterator():
        m = model.setdefault(r.lang, {"abbr": {}, "known": {}, "ordinal": set()})
        if r.abbr:
            m["abbr"][r.a] = -1.0 if r.ends is None else r.ends
        if r.common or r.starter:
            m["known"][r.a] = r.rate
        if r.ordinal:
            m["ordinal"].add(r.a)
    return model


def _quotes(text: str) -> tuple[dict[int, int], dict[int, int]]:
    """Opening to closing position of matched quotes and brackets, and back. A blank line closes whatever is open."""
    pair, back, stack = {}, {}, []
    for m in _QUOTE.finditer(text):
        ch, i = m[0], m.start()
        if len(ch) > 1:
            stack.clear()
            continue
        top = stack[-1][0] if stack else ""
        ends = (top == "„" and ch in "“”") or (top == "“" and ch == "”") or (top == "»" and ch == "«") or (top == "«" and ch == "»") or (top == '"' and ch == '"') or PAIRS.get(top) == ch
        if ends:
            j = stack.pop()[1]
            pair[j], back[i] = i, j
        elif ch in '„“«»"' or ch in PAIRS:
            stack.append((ch, i))
        elif ch in "”":
            back[i] = -1
    return pair, back


_INNER, _STRIP = ".'’-‐", ".,;:!?…()[]{}„”“»«\"'’。！？，"


def _word_before(text: str, i: int, start: int) -> str:
    """The word or number that ends at i; empty if there is none."""
    j = i
    while j > start and (text[j - 1].isalnum() or text[j - 1] in _INNER or text[j - 1] > "\u02ff" and unicodedata.category(text[j - 1])[0] == "M"):
        j -= 1
    word = text[j:i].lstrip(_INNER)
    if word and (text[j - 1 : j] in (",", ":", "/") or not word.isalpha()):
        while j > start and not text[j - 1].isspace():
            j -= 1
        m = _BEFORE.search(text, j, i)
        return m[0] if m else ""
    return word


class Cutter:
    def __init__(self, model: dict[str, dict]):
        empty = {"abbr": {}, "known": {}, "ordinal": set()}
        self.all, self.model = model.get("*", empty), model
        self.mid: set[str] = {w for m in model.values() for w, ends in m["abbr"].items() if ends < 0.5}  # abbreviations of any language that do not end sentences
        self.languages = [x for x in sorted(model) if x not in ("*", "und")]
        self.spoken: dict[str, list[int]] = {}
        for w in self.all["known"]:
            rates = [model[x]["known"].get(w, 0.0) for x in self.languages]
            most = max(rates, default=0.0)
            if most > 0:  # a word of a mixed text is rare in the code it came under
                self.spoken[w] = [k for k, x in enumerate(rates) if x >= 0.3 * most]

    def _paragraphs(self, text: str, language: str | None) -> list[tuple[int, dict]]:
        """Where each paragraph ends, and the tables of the language that knows most of its words; codes may be wrong and texts mixed."""
        out, at = [], 0
        for end in [*(m.end() for m in _BLANK_LINE.finditer(text)), len(text)]:
            hits = [0] * len(self.languages)
            for w in text[at:end].lower().split():
                for k in self.spoken.get(w.strip(_STRIP), ()):
                    hits[k] += 1
            best = max(hits, default=0)
            top = [x for x, n in zip(self.languages, hits, strict=True) if n == best] if best else []
            name = language if language in top or not top else min(top)
            out.append((end, self.model.get(name, self.all) if name not in (None, "und") else self.all))
            at = end
        return out

    def _end(self, lang: dict, text: str, at: int, word: str, nxt: str, start: int) -> bool:
        """Whether a period after ``word`` at ``at`` ends a sentence when ``nxt``, capitalised or without case, follows."""
        low, key = word.lower(), nxt.lower()
        known = key in lang["known"] or key in self.all["known"]
        inner = "." in word
        roman = bool(_ROMAN.match(word)) and word not in ("L", "C", "D", "M") and bool(_NUMBERED.search(text, max(start, at - len(word) - 6), at - len(word)))
        if word[0].isdigit() or roman or len(word) > 1 and _ROMAN.match(word):
            if key in lang["ordinal"] or key in self.all["ordinal"]:
                return False
            return len(text[start:at].strip()) > len(word) + 1  # else it is the marker of a list entry
        if _ROMAN.match(nxt) or len(nxt) == 1 and nxt.isupper():
            known = False  # a numeral or an initial
        short = len(text[start:at].split(None, 3)) <= 3
        if len(word) == 1 and word.isupper():
            return known and not short and len(nxt) > 1 and lang["abbr"].get(low, -1) >= 0.5
        ends = lang["abbr"].get(low)
        if ends is None:
            ends = self.all["abbr"].get(low)
            if ends is None and not inner:
                return True
            ends = -1.0 if ends is None else ends
        if short:
            return False
        return known or ends >= 0.5

    def _mark(self, lang: dict, text: str, i: int, j: int, back: dict[int, int], pair: dict[int, int], start: int) -> int:
        """The end of the sentence whose marks are text[i:j], or -1."""
        marks, n = text[i:j], len(text)
        k = j
        while k < n:
            if text[k] in CLOSE and (k in back or text[k] == "’") or k in back:
                k += 1
            elif text[k] in "   " and k + 1 < n and text[k + 1] in "»«" and k + 1 in back:
                k += 2
            else:
                break
        closed = k > j
        if closed and text[k : k + 1] in tuple(MARKS) and text[k : k + 1]:
            return -1  # the next cluster decides
        f = k
        while f < n and text[f].isspace():
            f += 1
        if f == n:
            return k
        nc, gap = text[f], f - k
        wide = marks[-1] in WIDE
        if closed and text[k - 1] in "”“»«」』\"" and REPORT["other"].match(text, k):
            return -1
        if closed and (wide or "　" < nc < "ꀀ") and (REPORT["cjk"].match(text, k) or text[k - 1] in "」』" and REPORT["と"].match(text, k)):
            return -1
        if nc in ",;:،，、；：)]}" and not (nc in ")]}" and gap):
            return -1
        if nc.islower():
            return -1
        if nc in "–—-":
            g = f + 1
            while g < n and text[g].isspace():
                g += 1
            line = _LINE_END.search(text, k, f)
            if g < n and text[g].islower() and not (line and _entry(text, f)) or g == f + 1 and nc == "-" and not line:
                return -1
            return k
        if wide:
            return k
        dots = marks == "…" or len(marks) > 1 and set(marks) <= set(".…")
        m = _TOKEN.match(text, f if f not in pair else f + 1) or _TOKEN.search(text, f)
        nxt = m[0] if m else ""
        if dots:
            return k if nc.isupper() or f in pair or closed else -1
        if marks[-1] != "." or closed and marks != ".":
            return k if gap or nc.isupper() or f in pair or not nc.isalnum() or not nc.isascii() else -1
        word = _word_before(text, i, start)
        if not gap and not closed:
            if nc.isdigit() or not (nc.isupper() or f in pair or nc.isalpha()):
                return -1
            if len(word) == 1 and word.isupper() and not _NUMBERED.search(text, max(start, i - 7), i - 1) or len(nxt) == 1 and text.startswith(".", f + 1):
                return -1
        if not word:
            return k
        if closed:
            return k
        if nc.isdigit():
            if _LINE_END.search(text, k, f) and _entry(text, f):
                return k
            low = word.lower()
            ends = lang["abbr"].get(low, self.all["abbr"].get(low))
            return k if not word[0].isdigit() and len(word) > 1 and "." not in word and low not in self.mid and (ends is None or ends >= 0.5) else -1
        return k if self._end(lang, text, i, word, nxt, start) else -1

    def __call__(self, text: str, language: str | None) -> list[tuple[int, int]]:
        parts, p = self._paragraphs(text, language), 0
        pair, back = _quotes(text)
        events = [(m.start(), 0, m.end()) for m in _CLUSTER.finditer(text)]
        events += [(m.start(), 1, m.end()) for m in _BREAK.finditer(text)]
        if _HAS_UNMARKED.search(text):
            events += [(m.start(), 2, m.end()) for m in _UNMARKED_GAP.finditer(text)]
        events.sort()
        starts = [0, *(m.end() for m in _LINE_END.finditer(text))]
        lengths = sorted(len(x.rstrip()) for x in _LINE_END.split(text))
        width = lengths[-2] if len(lengths) > 3 else lengths[-1]  # of four lines or more one may run over
        held = []  # quotations with a reporting clause: no end inside
        for o, c in pair.items():
            if text[o] in "„“«»\"「『" and c - o > 2:
                rest = _BLANK_LINE.split(text[c + 1 : _AHEAD.match(text, c + 1).end() + 40], maxsplit=1)[0]
                line = _BREAK.match(rest)
                if line and _entry(text, c + 1 + line.end()) and not rest.lstrip()[:1] == "–":
                    continue
                head = rest.lstrip("  \n\r,")
                clause = head[:1].islower() or re.match(r"[–—-]\s*[^\W\d_]", head) and head.lstrip("–—- \n\r ")[:1].islower()
                clause = clause or REPORT["other"].match(text, c + 1) or text[o] in "「『" and rest.startswith("と") or "　" < rest[:1] < "ꀀ" and REPORT["cjk"].match(text, c + 1)
                if clause or text[:o].rstrip()[-1:] == ":":
                    held.append((o, c))
        held.sort()
        ends, start, h = [], 0, 0
        for a, kind, b in events:
            if a < start:
                continue
            while h < len(held) and held[h][1] < a:
                h += 1
            inside = h < len(held) and held[h][0] < a < held[h][1]
            if kind == 0:
                while a >= parts[p][0] and p + 1 < len(parts):
                    p += 1
                end = self._mark(parts[p][1], text, a, b, back, pair, start)
                if end > 0 and inside and end <= held[h][1]:
                    end = -1
            elif kind == 1:
                end = a if self._line(text, a, b, width, start, starts) else -1
            else:
                end = a if not inside and self._gap(text, a, b, start) else -1
            if end > start:
                ends.append(end)
                start = end
        out, at = [], 0
        for e in [*ends, len(text)]:
            unit = text[at:e]
            left = len(unit) - len(unit.lstrip())
            if left < len(unit):
                out.append((at + left, at + len(unit.rstrip())))
            at = e
        return out

    def _gap(self, text: str, a: int, b: int, start: int) -> bool:
        """Whether a blank ends a unit in a script without sentence marks."""
        i = a
        while i > start and not text[i - 1].isspace():
            i -= 1
        return bool(_HAS_UNMARKED.search(text, i, a)) and text[b] not in "ๆฯ)]}»”"

    def _line(self, text: str, a: int, b: int, width: int, start: int, starts: list[int]) -> bool:
        """Whether the line break text[a:b] ends a unit; breaks after sentence marks were decided there."""
        if b >= len(text) or len(_LINE_END.findall(text, a, b)) > 1:
            return True
        i = starts[bisect_right(starts, a) - 1]
        line = text[i:a]
        if _entry(text, b) and not (text[b] in "–—-" and line.rstrip()[-1:] in "”“»«\"" and line.rstrip()[-1:]):
            return True
        if not line.strip():
            return False
        nxt = _SOLID.match(text, b)[0]
        cjk = "　" <= text[b] < "ꀀ" or "　" <= line.rstrip()[-1:] < "ꀀ"
        fits = len(line.rstrip()) + (1 if cjk else 1 + len(nxt)) <= width - (0 if cjk else 2)
        marked = _entry(text, i + len(line) - len(line.lstrip()))
        if marked:
            return fits or not text[b].islower()
        if text[b].islower() or text[b] in "%‰,;)]" or line.rstrip()[-1] in ",;:-–—(„«":
            return False
        tail = re.search(rf"[{re.escape(MARKS)}][\s\"”“»«)\]」』’]*\Z", line)
        if tail:
            return False  # the period rule saw the sentence go on
        return fits and not text[start:i].strip() and not text[i:start].strip()  # a heading has its line to itself


def _entry(text: str, i: int) -> bool:
    """Whether a list entry begins at i: a bullet, or a number in sequence with its neighbours or 1."""
    m = _MARKER.match(text, i)
    if not m or m.end() == m.start() + len(m[0].rstrip()) and (m[1] in ("-", "*", "·", "–", "—") if m[1] else True) and not re.match(rf"[{UNMARKED}　-ꀀ]", text[m.end() : m.end() + 1]):
        return False
    if m[1]:
        if m[1] in "•▪◦‣*":
            return True
        end = _LINE_END.search(text, i)
        line = text[i : end.start() if end else len(text)]
        if not re.search(rf"[{re.escape(MARKS)}]\s*\Z|[{re.escape(MARKS)}]\s+[^\W\d_]", line):
            return True
        return bool(end) and text.startswith(m[1] + " ", end.end())
    if m[2] is None:
        return False
    number = int(m[2])
    if number == 1:
        return True
    j = i
    while j and text[j - 1].isspace():
        j -= 1
    k = j
    while k and not _LINE_END.match(text, k - 1):
        k -= 1
    before = _MARKER.match(text[k:j].lstrip())
    if before and before[2] and int(before[2]) == number - 1:
        return True
    end = _LINE_END.search(text, i)
    after = _MARKER.match(text, end.end()) if end else None
    return bool(after and after[2] and int(after[2]) == number + 1)


def units(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs (doc_id, text, lang) to (doc_id, start_char, end_char)."""
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", language(F.col("lang")).alias("language"), "text")
    cutter = scratch.spark.sparkContext.broadcast(Cutter(learn(rows.select("language", "text"), scratch)))

    def run(batches):
        for b in batches:
            at = [(d, s, e) for d, lang, t in zip(b["doc_id"], b["language"], b["text"], strict=True) for s, e in cutter.value(t, lang)]
            yield pd.DataFrame(at, columns=["doc_id", "start_char", "end_char"])

    return rows.mapInPandas(run, "doc_id bigint, start_char bigint, end_char bigint")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(table(spark, sf_dir, "documents"), Scratch(spark, "sentences")).distinct()


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language code: documents, units and the mean length of a unit."""
    docs = table(spark, sf_dir, "documents")
    got = units(docs, Scratch(spark, "sentences")).distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.sum(F.col("end_char") - F.col("start_char")).alias("chars"))
    out = got.join(docs.select("doc_id", language(F.col("lang")).alias("language")).distinct(), "doc_id").groupBy("language")
    return out.agg(F.count(F.lit(1)).alias("docs"), F.sum("units").alias("units"), (F.sum("chars") / F.sum("units")).alias("mean_chars"))


def p8_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document with units: the characters of its text that are no blanks, all of which stand in units, and units that overlap."""
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null").select("doc_id", "text").distinct()
    u = units(docs.withColumn("lang", F.lit(None).cast("string")), Scratch(spark, "sentences")).distinct().withColumn("late", F.col("start_char") < F.lag("end_char").over(Window.partitionBy("doc_id").orderBy("start_char", "end_char")))
    each = u.join(docs, "doc_id").withColumn("unit", F.expr("substr(text, cast(start_char as int) + 1, cast(end_char - start_char as int))"))
    return each.groupBy("doc_id").agg(F.sum(F.char_length(F.regexp_replace("unit", BLANK, ""))).alias("chars"), F.count_if("late").alias("overlaps"))


#: What counts as blank in the check of whole texts.
BLANK = r"(?U)[\s\x{1c}-\x{1f}]+"
SQL = {"p8_cover": "SELECT doc_id, CAST(length(t) AS BIGINT) AS chars, 0 AS overlaps FROM (SELECT DISTINCT doc_id, regexp_replace(text, '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\p{Z}]+', '', 'g') AS t FROM documents) WHERE t <> ''"}
QUERIES = {"p8_found": p8_found, "p8_report": p8_report, "p8_cover": p8_cover}
