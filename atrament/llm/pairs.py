"""Problem 2: broken prompt and response pairs.

Method: the openings of responses are clustered by verified MinHash. An opening is the first sentence, where it makes up half
of the words or more, else the whole output; only outputs count that stand apart from their input, most of whose words they
do not hold. Openings are linked that share five-word shingles to SIMILARITY or more (all texts of a MinHash band are
compared, by a prefix filter), and links carry on. A cluster that recurs across PROMPTS prompts or more, in KINDS kinds of
task or more, is a refusal template: an answer fits one prompt and one kind, only a refusal fits unrelated ones. No list of
words is used, so the language does not matter; a refusal whose wording no other prompt got is not found.
The remaining defects come from checks of each pair: content, copies of the input or of its parts, the end of the output
against the material and its form, and the language against that of the material or the one asked for.
Instructions are told from material by beginnings that recur across INPUTS different inputs or more; every line end and colon
of an input is tried. The language identifier learns from documents.

One defect is given, the first that holds of: empty, copy, refusal, wrong_language, truncated. Defined cases: status error,
null response_id: no pair; null output: empty; null input: only empty, refusal and truncated are checked; repeated rows of
a response_id count once (the latest); equal outputs share their opening; empty tables give no rows. Texts are read whole.
The different openings of one MinHash band are held by one task: they agree in ROWS minima, so they are near copies.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atrament.llm import identify
from atrament.operators.graph import components
from atrament.session import Scratch, lookup, table

SHINGLE, SIMILARITY = 5, 0.8
#: Texts of a similarity of SIMILARITY share a band with probability 0.998.
BANDS, ROWS = 12, 4
#: A template recurs over this many different prompts, in this many kinds of task.
PROMPTS, KINDS = 3, 2
#: An instruction opens this many different inputs.
INPUTS = 4

#: Names of languages in instructions that ask for a translation.
ASKED = [(x, regex.compile(p, regex.IGNORECASE)) for x, p in [("pl", r"polsk|polnisch|polish|polštin|polonais"), ("en", r"angielsk|englisch|english|angličtin|anglais"), ("de", r"niemieck|deutsch|german|němčin|allemand"), ("cs", r"czesk|tschechisch|czech|češtin|tchèque"), ("fr", r"francusk|französisch|french|francouzštin|français"), ("la", r"łacin|latein|latin"), ("uk", r"ukraiń|ukrainisch|ukrainian|ukrajinštin"), ("ru", r"rosyjsk|russisch|russian|ruštin")]]

_NO_LETTER, _DIGITS, _GAP = re.compile(r"[\W_]+"), re.compile(r"\d+"), re.compile(r"\s+")
_TAGS = re.compile(r"<[^<>]{0,40}>|```[a-z]*|\\n")
_CUT = re.compile(r":\s+|\s*\n\s*")
_KEPT = re.compile(r"(?:OCR|JSON|Polish|German|Czech|English|Seite|Blatt|Zeile|Felder|Rechnung|Text|Lesefehler|Zwróć|Tschech|Engl|Poln|Deutsch)")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}]+)*")
_DRESS = regex.compile(r"^[\s\p{Z}\p{C}\"'„”“»«‚‘’`*_>#|=~–—-]+|[\s\p{Z}\p{C}\"'„”“»«‚‘’`*_>#|=~–—-]+$")
_FENCE = regex.compile(r"^```[a-z]*\s*\n?|\n?```\s*$", regex.MULTILINE)
_QUOTE = tuple("„“”»«\"'‚‘「『")
_STOP = regex.compile(r"[.!?…。！？।؟]+[\"'”“»«)\]」』’*_`]*(?=\s|\Z)|[。！？]+")
_END = regex.compile(r"(?:[.!?…。！？।؟]|[.!?…]\s*)[\"'”“»«)\]」』’*_`]*\Z")


def letters(text: str | None) -> str:
    """Lower case, letters and digits only."""
    return _NO_LETTER.sub("", unicodedata.normalize("NFC", text or "").lower())


def is_empty(output: str | None) -> bool:
    if output is None:
        return True
    t = letters(_TAGS.sub(" ", output))
    return not t or t in ("null", "none", "nil", "nan", "undefined")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower().replace("’", "'"))


def opening(output: str | None) -> str | None:
    """The words of the first sentence, of the whole output where these are less than half; None for one that opens with a quotation."""
    if output is None:
        return None
    t = output.lstrip()
    if t.startswith(_QUOTE) and len(t) > 1 and not t.rstrip().endswith(_QUOTE):
        return None
    stop, whole = _STOP.search(t), words_of(t)
    first = words_of(t[: stop.end()]) if stop else whole
    return " ".join(first if 2 * len(first) >= len(whole) else whole) or None


def is_apart(text: str | None, output: str) -> bool:
    """Less than half of the output's words stand in the input."""
    seen, words = set(_WORD.findall((text or "").lower())), _WORD.findall(output.lower())
    return sum(w in seen for w in words) < 0.5 * len(words)


def _is_name(word: str) -> bool:
    return word[:1].isupper() and not _KEPT.match(word)


def cuts(text: str | None) -> list[tuple[int, int]]:
    """Where an input may be cut into instruction and material, after each colon and line: a key of the beginning, in which
    numbers are # and capitalised words names, and the offset of the material. Keys are carried from cut to cut."""
    t = text or ""
    out, key, last, lead = [], 0, 0, len(t) - len(t.lstrip())
    for m in _CUT.finditer(t):
        for w in _GAP.split(t[last : m.end()].strip()):
            if w:
                w = "@" if key and _is_name(w) else _DIGITS.sub("#", w)
                key = (key * 0x9E3779B97F4A7C15 + zlib.crc32(w.encode("utf-8", "surrogatepass")) + 1) & 0xFFFFFFFFFFFFFFFF
        last = m.end()
        if m.start() + m[0].startswith(":") - lead >= 8:
            out.append((key - (1 << 64) if key >> 63 else key, last))
    return out


class Judge:
    """Names the defect of a pair. ``at`` are the offsets where the input may be cut, ``known`` those where a known instruction ends."""

    def __init__(self, identifier: identify.Identifier):
        self.identifier = identifier

    @staticmethod
    def split(text: str, at: list[int], known: list[int]) -> tuple[str, str]:
        """Instruction and material; the instruction is empty where none opens the input."""
        known = [x for x in known if text[x:].strip()]
        if not known:  # a rare instruction still stands in a line of its own
            line = text.find("\n")
            for x in at if line >= 0 else ():
                last = text[:x].split()[-1:]
                if x > line and last and last[0].endswith((":", "?", ".")) and not _is_name(last[0]) and text[x:].strip():
                    known = [x]
                    break
        best = next((x for x in known if "\n" in text[:x]), known[-1] if known else 0)
        return text[:best].strip(), text[best:].strip()

    @staticmethod
    def parts(text: str, whole: str, at: list[int], out: str) -> set[str]:
        """Of the letters of the input, ``whole``, and of what each cut leaves and is: those that ``out`` holds. A beginning
        stands in it if a longer one does, and an end if a longer one does, so that few are looked for."""
        got = {whole} if len(whole) <= len(out) and whole in out else set()
        ends = [0]
        for x, y in zip([0, *at], at, strict=False):
            ends.append(ends[-1] + len(letters(text[x:y])))
        first = bisect_left(ends, True, key=lambda n: whole[:n] not in out)
        last = bisect_left(ends, True, key=lambda n: whole[n:] in out)
        return got | {whole[:n] for n in ends[:first]} | {whole[n:] for n in ends[last:]}

    def is_copy(self, kind: str, text: str, output: str, reference: str | None, head: str, body: str, at: list[int]) -> bool:
        core = _DRESS.sub("", _FENCE.sub("", output.strip()))
        out = letters(core)
        if not out:
            return False
        if reference is not None and core.strip() == reference.strip():
            return False
        whole, inner, top = letters(text), letters(body), letters(head)
        if len(inner) < 4:
            return False
        if kind == "preserve_clean" and inner in out and len(out) <= len(inner) + 20 and not (top and out.startswith(top)):
            return False
        if kind.startswith("repair") and inner in out and out.count(inner) == 1 and len(out) <= len(inner) + 24 and not (top and top in out):
            # the letters are the same: a copy only if what else is wrong in the material was left as it was
            bare = lambda s: _DRESS.sub("", regex.sub(r"[ \t]+", " ", s)) if "  " not in body else _DRESS.sub("", s)
            a, b = bare(body), bare(core)
            keep = lambda s: regex.sub(r"\s*\n\s*", " ", s).casefold()
            if keep(a) not in keep(b):
                return False
        left = out
        forms = {whole, inner, top} | (set() if kind == "preserve_clean" or kind.startswith("repair") else self.parts(text, whole, at, out))
        for form in sorted(forms, key=len, reverse=True):
            if 6 <= len(form) <= len(left):
                left = left.replace(form, "\0")
        rest = left.replace("\0", "")
        return "\0" in left and len(rest) <= 20 and (not rest or len(_WORD.findall(core)) - sum(len(_WORD.findall(x)) for x in (body if inner in out else head,)) <= 3 or left.count("\0") > 1)

    def is_truncated(self, kind: str, output: str, finish: str | None, status: str | None, body: str) -> bool:
        t = output.rstrip()
        core = _FENCE.sub("", t).strip()
        cut = finish == "length" or status == "incomplete"
        if core[:1] in "{[":
            try:
                json.loads(core)
                return False
            except ValueError:
                return not core.endswith(("}", "]"))
        if kind.startswith("repair") or kind == "preserve_clean":
            a, b = letters(body), letters(core)
            if not a:
                return not _END.search(t)
            if len(b) >= 0.97 * len(a) or _close(a[-10:], b[-10:]) and len(b) >= 0.85 * len(a):
                return False
            n = min(len(b), 12)
            return len(b) < 0.97 * len(a) and (_close(a[:n], b[:n]) or cut or not _END.search(t)) and not (_END.search(t) and len(b) >= 0.9 * len(a))
        if kind == "translate" and body:
            marks = lambda s: len(regex.findall(r"[.!?…。！？]+(?=[\s\"”“»)]|\Z)", s))
            if not _END.search(t):
                return bool(_END.search(body)) or cut
            return marks(core) < marks(body) and len(core) < 0.75 * len(body)
        if not _END.search(t):
            return True
        word = regex.search(r"([\p{L}]{1,4})\.\Z", t)
        if word and body:
            # the output ends like an abbreviation: the material tells whether its sentence goes on
            tail = t[-14:]
            at = body.find(tail)
            if at >= 0:
                rest = body[at + len(tail) :].lstrip()
                return bool(rest) and (rest[0].islower() or rest[0].isdigit() or rest[0] in ",;") or bool(cut and rest and len(word[1]) == 1)
            return bool(cut and len(word[1]) <= 2)
        return False

    def is_wrong(self, kind: str, text: str, output: str, head: str, body: str) -> bool:
        core = _FENCE.sub("", output).strip()
        if core[:1] in "{[":
            return False
        if kind == "translate":
            goal = self.asked(head or text)
            got = self.identifier(core) if goal else None
            return got is not None and got != goal
        # much of the material in the output speaks for its language, whatever the words around it
        a, b = set(_WORD.findall(body.lower())), _WORD.findall(core.lower())
        if sum(w in a for w in b) >= 0.5 * len(b):
            return False
        got, own = self.identifier(core), self.identifier(body, 0.1)
        return got is not None and own is not None and own != got

    @staticmethod
    def asked(instruction: str) -> str | None:
        """The language that an instruction names first."""
        found = [(m.start(), x) for x, p in ASKED if (m := p.search(instruction))]
        return min(found)[1] if found else None

    def __call__(self, kind, text, output, reference, finish, status, template, at=(), known=()) -> str | None:
        kind = kind or ""
        if is_empty(output):
            return "empty"
        head, body = self.split(text, at, known) if text else ("", "")
        if text is not None and self.is_copy(kind, text, output, reference, head, body, at):
            return "copy"
        if template:
            return "refusal"
        if text is not None and self.is_wrong(kind, text, output, head, body):
            return "wrong_language"
        return "truncated" if self.is_truncated(kind, output, finish, status, body) else None


def _close(a: str, b: str) -> bool:
    """At most one edit in four."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] * 4 <= max(len(a), len(b), 1)


def shingles(text: str) -> np.ndarray:
    """Hashes of the shingles of a masked text, sorted, each once."""
    w = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in text.split()], np.uint64)
    h = np.zeros(max(1, len(w) - SHINGLE + 1), np.uint64)
    for i in range(min(SHINGLE, len(w))):
        h = (h ^ w[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


_A = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _bands(batches):
    for b in batches:
        ids, keys = [], []
        for i, text in zip(b["id"], b["text"], strict=True):
            h = shingles(text)[:, None] * _A[None, :]
            least = (h ^ (h >> np.uint64(31))).min(0)
            for k in range(BANDS):
                ids.append(i)
                keys.append(hash((k, *least[k * ROWS : k * ROWS + ROWS].tolist())))
        yield pd.DataFrame({"id": ids, "band": keys})


def _alike(x: set, y: set) -> bool:
    small, large = sorted((len(x), len(y)))
    return small >= SIMILARITY * large and len(x & y) >= SIMILARITY * len(x | y)


def _linked(texts: list[str]) -> list[tuple[str, str]]:
    """Links that join all texts of a band that are alike. Alike texts share one of their rarest shingles: of n, those but
    SIMILARITY * n (prefix filter); so only texts that share one are compared, and with one cluster only until they are in it."""
    sets = [set(shingles(t).tolist()) for t in texts]
    often = Counter(x for s in sets for x in s)
    up, met, out = list(range(len(sets))), {}, []

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, s in enumerate(sets):
        first = sorted(s, key=lambda x: (often[x], x))[: len(s) - math.ceil(SIMILARITY * len(s) - 1e-9) + 1]
        seen = set()
        for x in first:
            for root, members in met.get(x, {}).items():
                if top(root) == top(i):
                    continue
                for j in members:
                    if j not in seen and _alike(s, sets[j]):
                        up[top(i)] = top(j)
                        out.append((texts[i], texts[j]))
                        break
                    seen.add(j)
        for x in first:
            met.setdefault(x, {}).setdefault(top(i), []).append(i)
    return out


def _links(batches):
    """Rows (band, text) in order of bands to links of texts."""
    band, texts = None, []
    for b in batches:
        out = []
        for key, text in zip(b["band"], b["text"], strict=True):
            if key != band:
                out += _linked(texts)
                band, texts = key, []
            texts.append(text)
        yield pd.DataFrame(out, columns=["u", "v"], dtype=object)
    yield pd.DataFrame(_linked(texts), columns=["u", "v"], dtype=object)


def templates(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (opening, prompt, category) to (opening, template): openings of recurring templates."""
    seen = scratch.keep(rows.where("opening is not null").select("opening", "prompt", F.coalesce("category", F.lit("")).alias("kind")).distinct())
    texts = scratch.keep(seen.select(F.col("opening").alias("text")).distinct().withColumn("id", F.xxhash64("text")))
    bands = scratch.keep(texts.mapInPandas(_bands, "id bigint, band bigint"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("band")
    members = bands.join(shared, "band").join(texts, "id").select("band", "text")
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    links = members.repartition(parts, "band").sortWithinPartitions("band", "text").mapInPandas(_links, "u string, v string").distinct()
    labels, m = scratch.count(components(links, scratch).select(F.col("v").alias("opening"), "root"))
    placed = lookup(seen, labels, "opening", rows=m).withColumn("root", F.coalesce("root", "opening"))
    each = placed.groupBy("root", "prompt").agg(F.min("kind").alias("lo"), F.max("kind").alias("hi"))
    few = each.groupBy("root").agg(F.count(F.lit(1)).alias("p"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where((F.col("p") >= PROMPTS) & (F.col("lo") < F.col("hi")))
    found = scratch.keep(few.select("root"))
    openings = placed.select("opening", "root").distinct()
    got = scratch.keep(lookup(openings, found, "root", "inner").select("opening", F.lit(True).alias("template")))
    for t in (texts, bands, seen, labels, found):
        scratch.drop(t)
    return got


def judged(responses: DataFrame, documents: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per pair: response_id, category, defect (null: none)."""
    cols = ["category", "input", "output", "reference", "finish_reason", "status"]
    rows = responses.where("response_id is not null").groupBy("response_id").agg(F.max(F.struct("received_at", *cols)).alias("r")).select("response_id", *[F.col("r")[c].alias(c) for c in cols])
    rows = rows.where("status is null or status <> 'error'")

    def read(batches):
        for b in batches:
            pairs = list(zip(b["input"], b["output"], strict=True))
            ops = [opening(y) if isinstance(y, str) and not is_empty(y) and is_apart(x, y) else None for x, y in pairs]
            found = [cuts(x) for x, _ in pairs]
            yield b.assign(opening=ops, keys=[[k for k, _ in f] for f in found], at=[[i for _, i in f] for f in found])

    ddl = "response_id bigint, " + ", ".join(f"{c} string" for c in cols)
    rows = scratch.keep(rows.mapInPandas(read, ddl + ", opening string, keys array<bigint>, at array<int>").withColumn("prompt", F.xxhash64("input")))
    beginnings = rows.where("size(keys) > 0").groupBy("prompt").agg(F.first(F.arrays_zip("keys", "at")).alias("c")).select("prompt", F.explode("c").alias("c")).select("prompt", F.col("c.keys").alias("key"), F.col("c.at").alias("at"))
    beginnings = scratch.keep(beginnings)
    often, n = scratch.count(beginnings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= INPUTS).select("key"))
    known = lookup(beginnings, often, "key", "inner", rows=n).groupBy("prompt").agg(F.array_sort(F.collect_list("at")).alias("known"))
    # both sides grow with the data, so they are merged; a frequent prompt is split by the adaptive skew join
    marked = lookup(rows.drop("keys").join(known.hint("merge"), "prompt", "left"), templates(rows, scratch), "opening")
    judge = scratch.spark.sparkContext.broadcast(Judge(identify.fit(documents)))

    def run(batches):
        for b in batches:
            b = b.astype(object).where(b.notna(), None)
            given = zip(b["category"], b["input"], b["output"], b["reference"], b["finish_reason"], b["status"], b["template"], b["at"], b["known"], strict=True)
            got = [judge.value(*x, () if at is None else list(at), () if known is None else list(known)) for *x, at, known in given]
            yield pd.DataFrame({"response_id": b["response_id"].astype("int64"), "category": b["category"], "defect": got})

    return marked.select("response_id", *cols, "template", "at", "known").mapInPandas(run, "response_id bigint, category string, defect string")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judged(table(spark, sf_dir, "responses"), table(spark, sf_dir, "documents"), Scratch(spark, "pairs"))
    return got.where("defect is not null").select("response_id", "defect")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by category and defect."""
    got = judged(table(spark, sf_dir, "responses"), table(spark, sf_dir, "documents"), Scratch(spark, "pairs"))
    return got.groupBy("category", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count(F.lit(1)).alias("pairs"))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
