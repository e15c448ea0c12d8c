"""Problem 1: noise in text from scanned pages.

Method: page furniture is found by fuzzy line repetition at page edges: a line's key has letters only, with confusable
shapes merged, so that misread headers keep their key; a key counts for a work if it recurs on a good share of its pages'
edges and for the corpus if it lives at edges only. Page numbers must fit the work's number sequence. The rest is running
text. A corpus vocabulary counted over all running lines decides whether a line end is a broken word (the joined word is
known, or no hyphenated compound is) with or without a hyphen, and which unknown words are misread forms of known ones: an
unknown word must be spelt from a much more frequent known word by known confusions of shapes.

Orders within a work, which may hold a third of all pages, are kept in blocks of BLOCK pages and then over blocks.

Defined cases: rows of one page_no that occur again count once (the latest); a null page_no is ignored, a null
work_family is a work of its own; null lines, null or blank raw texts are running text without defect; pages without
lines have no rows; empty tables give none; lines of any length are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache, lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atrament.session import Scratch, lookup, table

BLOCK = 512
#: A word of the vocabulary has at least this share of all words, so there are at most 1 / LEAST of them.
LEAST = 1e-6
#: A known word is this many times as frequent as a form taken for its misreading.
RATIO = 12
#: Lines looked at from the top and from the bottom of a page.
TOP, BOTTOM = 3, 4
#: A header recurs on this share of its work's pages; of the corpus' lines with its key this share is at edges.
OF_WORK, AT_EDGE = 0.2, 0.8
#: A sequence of numbers, as of front matter, is kept up on three pages and this share of a work's pages.
SEQUENCE = 0.005

HYPHENS = "-‐‑–—¬­=~"

#: Shapes that recognition confuses, as printed and as read.
CONFUSIONS = [
    ("a", "@"), ("ą", "a̧"), ("ą", "@̧"), ("b", "6"), ("b", "h"), ("c", "e"), ("c", "o"), ("d", "cl"), ("e", "c"), ("e", "o"), ("ę", "ç"), ("f", "t"), ("g", "q"), ("g", "9"),
    ("h", "b"), ("i", "j"), ("i", "l"), ("i", "1"), ("k", "lc"), ("l", "1"), ("l", "i"), ("l", "t"), ("ł", "t"), ("ł", "l"), ("m", "rn"), ("m", "in"), ("m", "ni"), ("n", "u"), ("n", "ri"), ("n", "ii"), ("o", "0"),
    ("ó", "6"), ("p", "þ"), ("r", "i"), ("r", "j"), ("s", "5"), ("s", "ſ"), ("s", "f"), ("ś", "s'"), ("t", "f"), ("t", "l"), ("u", "ii"), ("u", "n"), ("ů", "u"), ("w", "vv"), ("z", "2"), ("ż", "z"), ("ź", "z"),
    ("š", "s"), ("č", "c"), ("ř", "r"), ("ž", "z"), ("ü", "ii"), ("ü", "u"), ("ö", "o"), ("ä", "a"), ("ß", "B"), ("ß", "ss"), ("B", "8"), ("E", "F"), ("G", "6"), ("I", "l"), ("I", "1"), ("O", "0"), ("S", "5"), ("Z", "2"), ("Q", "O"),
]

#: Shapes merged in keys, after the pairs; marks are dropped.
_MERGE = str.maketrans({"j": "i", "l": "i", "1": "i", "r": "i", "!": "i", "|": "i", "c": "e", "o": "e", "0": "e", "u": "n", "t": "f", "ł": "f", "h": "b", "6": "b", "s": "f", "5": "f", "ſ": "f", "2": "z", "@": "a", "q": "g", "9": "g", "þ": "p", "8": "b"})
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}@'’ſþ]+(?:-[\p{L}\p{M}\p{N}@'’ſþ]+)*")
_SHAPES, _FIRST = regex.compile(r"[\p{L}\p{M}\p{N}@'ſþ]+"), regex.compile(r"[\p{L}\p{M}\p{N}@'ſþ]+")
_WHOLE, _HEAD_OF = regex.compile(r"[\p{L}\p{M}\p{N}@'ſþ-]+"), regex.compile(r"([\p{L}\p{M}\p{N}@'ſþ]+)-\Z")
_PARTS = re.compile(r"\s{2,}|\s\|\s")
_NUMERAL = regex.compile(r"[ivxlcdm]+\Z", regex.IGNORECASE)
_DIGITS = str.maketrans("oOlIiszSZBbgqQ", "00111525286990")
_PAGE = re.compile(r"(?:(?:str|s|p|pag|page|seite|strona)\.?\s*)?[\s\[\](){}*·•|.:,—–-]*([0-9?OolIiszSZBbgqQ]{1,5}|[ivxlcdm]{1,9}|[IVXLCDM]{1,9})[\s\[\](){}*·•|.:,—–-]*\Z", re.IGNORECASE)
_DECORATED = re.compile(r"(?:[\[({*•|—–-]|str\b|pag\b)", re.IGNORECASE)
_SIGN = re.compile(r"\s*(?:\d{1,3}\s?\*|[A-Z]{1,2}\s?\d{0,2}\s?\*?|(?:[\w.]+\s+){0,4}(?:ark|arkusz|bogen|bg|sig|sheet)\.?\s*[\dIVXLCDMilo]{1,5}\*?|.{3,50}\bT(?:om)?\.?\s*[IVXLCDMl]+\.?\s+[\dlO]{1,3}\*?)\s*\Z", re.IGNORECASE)


#: Letters as the strokes they share with the pairs they are read as: rn, in and ni are m, ri and ii are n or u, lc is k, cl is d, vv is w.
_STROKES = str.maketrans({"m": "iii", "n": "ii", "k": "ie", "d": "ei", "w": "vv"})


def fold_shapes(text: str) -> str:
    """A key that a word keeps when single shapes are confused."""
    t = unicodedata.normalize("NFD", text.lower().replace("ß", "b").replace("ó", "6"))
    return "".join(c for c in t if unicodedata.category(c)[0] != "M").replace("s'", "s").translate(_MERGE)


def shape_key(word: str) -> str:
    """A key that a word of any length keeps when shapes, or letters and pairs of letters, are confused."""
    return fold_shapes(word).translate(_STROKES)


@lru_cache(200_000)
def _rough(word: str) -> str:
    """A shorter key that also merges letters with the pairs they are read as."""
    t = fold_shapes(word)
    for pair, one in (("ii", "n"), ("in", "m"), ("ni", "m"), ("ei", "d"), ("ie", "k"), ("vv", "w")):
        t = t.replace(pair, one)
    return t.replace("d", "k").replace("m", "n").replace("n", "i")


def line_key(text: str | None) -> str:
    """Letters of a line with confusable shapes merged; words that hold digits, and numerals at its ends, are left out."""
    words = [w for w in _SHAPES.findall(text or "") if any(map(str.isalpha, w))]
    words = [w for w in words if not (_NUMERAL.match(w) and len(w) < 8) and sum(c.isdigit() for c in w) * 2 < len(w)]
    return "".join(_rough(w) for w in words)


def page_number(text: str | None) -> set[int]:
    """The numbers that a line which holds nothing else may mean."""
    m = _PAGE.match((text or "").strip())
    if not m:
        return set()
    t, out = m[1], set()
    digits = t.translate(_DIGITS)
    if any(c.isdigit() for c in t):
        out |= {int(digits.replace("?", d)) for d in "0123456789"} if digits.replace("?", "0").isdigit() else set()
    if _NUMERAL.match(t):
        value, last = 0, 0
        for c in reversed(t.lower()):
            v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c]
            value += v if v >= last else -v
            last = max(last, v)
        out.add(value)
    return out


def pages_of(raw: DataFrame) -> DataFrame:
    """One row per page: page_no, work_family (null becomes empty), page_number, lines."""
    keep = ["work_family", "page_number", "lines"]
    once = raw.where("page_no is not null").groupBy("page_no").agg(F.max_by(F.struct(*keep), F.col("scanned_at")).alias("r"), F.first(F.struct(*keep), ignorenulls=True).alias("f"))
    r = F.coalesce("r", "f")
    lines = F.filter(r["lines"], lambda x: x.isNotNull() & x["line_index"].isNotNull())
    lines = F.array_sort(F.transform(lines, lambda x: F.struct(x["line_index"].alias("line_index"), F.coalesce(x["raw_text"], F.lit("")).alias("text"), F.coalesce(F.get(x["bbox"], F.lit(0)), F.lit(0)).alias("left"))))
    return once.select("page_no", F.coalesce(r["work_family"], F.lit("")).alias("work_family"), r["page_number"].alias("page_number"), F.coalesce(lines, F.array()).alias("lines")).where("size(lines) > 0")


def _keys(batches):
    """Rows (page_no, work_family, key, edge, n): keys of lines at the edges of each page, and of all lines inside, summed up (no page)."""
    for b in batches:
        out, inner = [], {}
        for no, work, lines in zip(b["page_no"], b["work_family"], b["lines"], strict=True):
            keys = {f"#{g - no}" for x in (*lines[:2], *lines[-2:]) for g in page_number(x["text"])}  # a sequence of numbers recurs as one key
            seen = set()
            for i, x in enumerate(lines):
                k = line_key(x["text"])
                if len(k) >= 4:
                    (keys if i < TOP or i >= len(lines) - BOTTOM else seen).add(k)
            out += [(no, work, k, True, 1) for k in keys]
            for k in seen:
                inner[k] = inner.get(k, 0) + 1
        yield pd.DataFrame(out + [(None, "", k, False, n) for k, n in inner.items()], columns=["page_no", "work_family", "key", "edge", "n"]).astype({"page_no": "Int64"})


def with_order(df: DataFrame, cols: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds columns of neighbours in a work's page order: name -> (column, "next" or "before"), where next is the value of
    the next row, before the last value that is not null in earlier rows. Windows run within blocks, then over blocks."""
    df = df.withColumn("_b", F.floor(F.col("page_no") / BLOCK))
    inner = Window.partitionBy("work_family", "_b").orderBy("page_no")
    outer = Window.partitionBy("work_family").orderBy("_b")
    ends, out = [], df
    for name, (c, way) in cols.items():
        if way == "next":
            out = out.withColumn(name, F.lead(c).over(inner))
            ends.append(F.min_by(c, "page_no").alias(name + "_e"))
        else:
            out = out.withColumn(name, F.last(c, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, -1)))
            ends.append(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("page_no"))).alias(name + "_e"))
    blocks = df.groupBy("work_family", "_b").agg(*ends)  # a row per BLOCK pages
    for name, (_, way) in cols.items():
        e = name + "_e"
        blocks = blocks.withColumn(name + "_o", F.lead(e).over(outer) if way == "next" else F.last(e, ignorenulls=True).over(outer.rowsBetween(Window.unboundedPreceding, -1)))
    blocks = blocks.select(F.struct("work_family", "_b").alias("_at"), *[n + "_o" for n in cols])
    out = lookup(out.withColumn("_at", F.struct("work_family", "_b")), blocks, "_at")
    last = F.lead(F.lit(1)).over(inner).isNull()
    for name, (_, way) in cols.items():
        out = out.withColumn(name, F.when(last, F.col(name + "_o")).otherwise(F.col(name)) if way == "next" else F.coalesce(F.col(name), F.col(name + "_o")))
    return out.drop("_at", "_b", *[n + "_o" for n in cols])


def find_furniture(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds furniture, the line_index values of furniture, to pages."""
    spark = scratch.spark
    each = scratch.keep(pages.select("page_no", "work_family", "lines").mapInPandas(_keys, "page_no bigint, work_family string, key string, edge boolean, n bigint"))
    keys = scratch.keep(each.groupBy("work_family", "key", "edge").agg(F.sum("n").alias("n")))
    works = pages.groupBy("work_family").agg(F.count(F.lit(1)).alias("pages"), F.mode(F.col("page_number") - F.col("page_no")).alias("shift"))
    corpus = keys.groupBy("key").agg(F.sum(F.when(F.col("edge"), F.col("n")).otherwise(0)).alias("at"), F.sum("n").alias("all"), F.count_if("edge").alias("works"))
    corpus = scratch.keep(corpus)
    own = keys.where("edge and n >= 2").join(corpus.where(F.col("at") >= AT_EDGE * F.col("all")).select("key"), "key").join(works, "work_family")
    # at most (TOP + BOTTOM) / OF_WORK keys of a work hold the share, and 40 / SEQUENCE offsets of numbers theirs
    share = F.when(F.col("key").startswith("#"), F.greatest(F.lit(3), SEQUENCE * F.col("pages"))).otherwise(OF_WORK * F.col("pages"))
    own = own.where(F.col("n") >= share).groupBy("work_family").agg(F.collect_set("key").alias("headers"))
    wide, n = scratch.count(corpus.where(~F.col("key").startswith("#") & (F.col("at") >= 0.9 * F.col("all")) & (F.col("works") >= 3) & (F.col("at") >= 4)).select("key"))
    everywhere = lookup(each.where("edge").select("page_no", "key"), wide, "key", "inner", rows=n).groupBy("page_no").agg(F.collect_list("key").alias("everywhere"))  # TOP + BOTTOM keys of a page at most
    numbered = with_order(pages.withColumn("at", F.when(F.col("page_number").isNotNull(), F.col("page_number") - F.col("page_no"))), {"shift_b": ("at", "before"), "shift_n": ("at", "next")})
    given = lookup(lookup(numbered, works, "work_family"), own, "work_family").join(scratch.keep(everywhere), "page_no", "left")

    def near(k: str, headers) -> bool:
        """Whether a key is a header's, or one edit in five from one."""
        if k in headers:
            return True
        return any(h[:1] != "#" and abs(len(h) - len(k)) * 5 <= len(h) and _distance(k, h, len(h) // 5) for h in headers)

    def run(batches):
        for b in batches:
            out = []
            shifts = zip(b["at"], b["shift_b"], b["shift_n"], b["shift"], strict=True)
            for work, no, given_shifts, headers, wide, lines in zip(b["work_family"], b["page_no"], shifts, b["headers"], b["everywhere"], b["lines"], strict=True):
                headers, wide = (set(x) if x is not None else set() for x in (headers, wide))
                numbers = [int(no + x) for x in given_shifts if x is not None and x == x]
                numbers = numbers[:1] if given_shifts[0] is not None and given_shifts[0] == given_shifts[0] else numbers  # the page's own, else what its neighbours and its work say
                names = {_rough(w) for w in re.split(r"[\W\d_]+", work)[1:] if len(w) >= 5}
                n, found = len(lines), []

                def furniture(i: int, text: str, bottom: bool) -> bool:
                    t = text.strip()
                    if not t:
                        return False
                    got = page_number(t)
                    if any(_like(g, x) for g in got for x in numbers) or got and i in (0, n - 1) and (_DECORATED.match(t) or not numbers):  # noqa: B023
                        return True
                    for part in _PARTS.split(t) if i in (0, 1, n - 1, n - 2) else ():  # noqa: B023
                        if part != t and any(_like(g, x) for g in page_number(part) for x in numbers):  # noqa: B023
                            return True
                    if any(f"#{g - no}" in headers for g in got):  # noqa: B023
                        return True
                    if bottom and _SIGN.match(t) and i >= n - 3:  # noqa: B023
                        return True
                    k = line_key(t)
                    if len(k) >= 4 and (k in wide or near(k, headers)) and not _goes_on(t):  # noqa: B023
                        return True
                    return not re.search(r"[.?!;,][”\"]?\s*\Z", t.rstrip("0123456789 .")) and any(w in k for w in names) and t[:1].isupper() and len(k) <= 3 * max(map(len, names))  # noqa: B023

                i = 0
                while i < min(TOP, n) and furniture(i, lines[i]["text"], False):
                    found.append(lines[i]["line_index"])
                    i += 1
                j = n - 1
                while j > i and j >= n - BOTTOM and furniture(j, lines[j]["text"], True):
                    found.append(lines[j]["line_index"])
                    j -= 1
                out.append(found)
            yield b[["page_no", "work_family", "lines"]].assign(furniture=out)

    return given.select("page_no", "work_family", "lines", "at", "shift_b", "shift_n", "shift", "headers", "everywhere").mapInPandas(run, _ddl(pages.select("page_no", "work_family", "lines")) + ", furniture array<int>")


def _goes_on(line: str) -> bool:
    """Whether a line begins in lower case, as running text may; a numeral before it does not count."""
    words = line.split()
    if len(words) > 1 and _NUMERAL.match(words[0].strip("[](){}*·•|.:,—–-")):
        words = words[1:]
    return next((c for w in words for c in w if c.isalnum()), "A").islower()


def _like(a: int, b: int) -> bool:
    """Whether two numbers are equal, or one digit or one page apart."""
    return abs(a - b) <= 1 or len(str(a)) == len(str(b)) > 1 and sum(x != y for x, y in zip(str(a), str(b), strict=True)) <= 1


def _distance(a: str, b: str, most: int) -> bool:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return False
        row = new
    return row[-1] <= most


def _tokens(text: str) -> list[tuple[int, str]]:
    return [(m.start(), m[0]) for m in _WORD.finditer(text)]


def _count_words(batches):
    for b in batches:
        got: dict = {}
        for lines, furniture in zip(b["lines"], b["furniture"], strict=True):
            drop = set(furniture)
            run = [x["text"] for x in lines if x["line_index"] not in drop]
            for i, text in enumerate(run):
                t = text.rstrip()
                words = _tokens(t)
                # the first and last words may be parts of broken ones
                for at, w in words:
                    if at == 0 and i > 0 or at + len(w) >= len(t) - 1 and t[-1:] in HYPHENS or at + len(w) == len(t):
                        continue
                    low = w.strip("'’").lower()
                    if any(c.isalpha() for c in low):
                        got[low] = got.get(low, 0) + 1
        yield pd.DataFrame(list(got.items()), columns=["word", "n"])


class Words:
    """The vocabulary: counts of known words, and known words by their shapes."""

    def __init__(self, counts: dict[str, int]):
        self.n = counts
        self.shapes: dict[str, list[str]] = {}
        self.heads: dict[str, int] = {}
        for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            if not any(c.isdigit() or c in "@ſþ" for c in w):
                self.shapes.setdefault(shape_key(w), []).append(w)
                if "-" in w:
                    head = w.split("-")[0]
                    self.heads[head] = self.heads.get(head, 0) + n
        self.memo: dict[str, tuple] = {}

    def __getstate__(self):
        return self.n

    def __setstate__(self, counts):
        self.__init__(counts)

    def source(self, word: str) -> tuple[str, int] | None:
        """The known word of which ``word`` is a misreading, and where they first differ; None if it is none."""
        low = word.strip("'’").lower()
        if low not in self.memo:
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[low] = self._source(low)
        return self.memo[low]

    def _source(self, low: str) -> tuple[str, int] | None:
        if len(low) < 2 or not any(c.isalpha() for c in low) or _NUMERAL.match(low) and len(low) < 6:
            return None
        own = self.n.get(low, 0)
        odd = any(c.isdigit() or c in "@ſþ'" for c in low)
        for v in self.shapes.get(shape_key(low), ()):  # from frequent to rare
            if v == low or self.n[v] < RATIO * max(1, own) and not odd or len(v) < 3 and not odd:
                continue
            if self.n[v] < 3 * max(1, own):
                continue
            at = spelt(v, low)
            if at is not None:
                return v, at
        return None


@cache
def _reads() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for a, b in CONFUSIONS:
        a, b = a.lower(), b.lower()
        for x in {b, unicodedata.normalize("NFC", b), unicodedata.normalize("NFD", b)}:
            out.setdefault(a, []).append(x)
    return out


def spelt(known: str, read: str) -> int | None:
    """Where ``read`` first differs from ``known``, if it comes from it by confusions of shapes, four or one in two letters at
    most; None if it does not. Strings of 400 letters or more without a blank are no words."""
    reads, dead = _reads(), set()

    def step(i: int, j: int, first: int, left: int) -> int | None:
        while i < len(known) and j < len(read) and known[i] == read[j] and known[i] not in reads:
            i, j = i + 1, j + 1
        if i == len(known):
            return first if j == len(read) and first >= 0 else None
        if (i, j, first < 0, left) in dead:
            return None
        if j < len(read) and known[i] == read[j]:
            got = step(i + 1, j + 1, first, left)
            if got is not None:
                return got
        if left:
            for r in reads.get(known[i], ()):
                if read.startswith(r, j):
                    got = step(i + 1, j + len(r), first if first >= 0 else j, left - 1)
                    if got is not None:
                        return got
        dead.add((i, j, first < 0, left))
        return None

    return step(0, 0, -1, max(4, len(read) // 2)) if abs(len(known) - len(read)) <= max(len(known), len(read)) // 2 and len(known) < 400 else None


def broken(words: Words, line: str, following: str | None) -> tuple[bool, str, str]:
    """Whether a line ends inside a word that goes on in the following line, with the two parts."""
    t = line.rstrip()
    if not following:
        return False, "", ""
    sign = t[-1:] in HYPHENS and t[-2:-1].isalnum() or t[-1:] in HYPHENS and t[-2:-1] in "@ſþ̧"
    stem = t[:-1] if sign else t
    b = _FIRST.match(following.lstrip())
    at = len(stem)
    while b and at and (stem[at - 1].isalnum() or stem[at - 1] in "@'" or stem[at - 1] > "\u02ff" and unicodedata.category(stem[at - 1])[0] == "M"):
        at -= 1
    if not b or not any(map(str.isalpha, b[0])) or not any(map(str.isalpha, stem[at:])):
        return False, "", ""
    x, y = stem[at:], b[0]
    before = _HEAD_OF.search(stem[:at]) if stem[at - 1 : at] == "-" else None
    low_x, low_y = x.lower(), y.lower()
    joined = (before[1].lower() + "-" if before else "") + low_x + low_y
    known = _count(words, joined)
    if sign:
        if y[:1].isupper() and not x.isupper():
            return False, "", ""
        compound = _count(words, low_x + "-" + _WHOLE.match(following.lstrip())[0].lower())
        if compound or known:
            return known > compound, x, y
        if words.heads.get(low_x, 0) >= 2 and words.n.get(low_y, 0):
            return False, "", ""
        return True, x, y
    if y[:1].isupper() and not x.isupper() or not known:
        return False, "", ""
    apart = min(words.n.get(low_x, 0), words.n.get(low_y, 0))
    return known > 4 * apart and not (words.n.get(low_x, 0) and words.n.get(low_y, 0) and apart * 4 > known), x, y


def _count(words: Words, word: str) -> int:
    n = words.n.get(word, 0)
    if n:
        return n
    got = words.source(word)
    return words.n[got[0]] if got else 0


def vocabulary(pages: DataFrame, scratch: Scratch) -> Words:
    counts = scratch.keep(pages.select("lines", "furniture").mapInPandas(_count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return Words({r.word: r.n for r in counts.where((F.col("n") >= 2) & (F.col("n") >= LEAST * total)).toLocalIterator()})


def marked(raw: DataFrame, scratch: Scratch) -> DataFrame:
    """pages with furniture, flags (per line: broken, misread) and the running text that goes on from the page before."""
    pages = scratch.keep(find_furniture(scratch.keep(pages_of(raw)), scratch))
    words = scratch.spark.sparkContext.broadcast(vocabulary(pages, scratch))
    text = F.transform(F.filter("lines", lambda x: ~F.array_contains("furniture", x["line_index"]) & (F.trim(x["text"]) != "")), lambda x: x["text"])
    some = pages.withColumn("first", F.try_element_at(text, F.lit(1))).withColumn("last", F.try_element_at(text, F.lit(-1)))
    bare = some.where("first is null").select("page_no", "work_family", "lines", "furniture", F.lit(None).cast("string").alias("after"), F.lit(None).cast("string").alias("prior"))
    full = with_order(some.where("first is not null"), {"after": ("first", "next"), "prior": ("last", "before")}).select("page_no", "work_family", "lines", "furniture", "after", "prior")

    def run(batches):
        for b in batches:
            out = []
            for lines, furniture, after, prior in zip(b["lines"], b["furniture"], b["after"], b["prior"], strict=True):
                drop = set(furniture)
                texts = [(x["line_index"], x["text"]) for x in lines if x["line_index"] not in drop and x["text"].strip()]
                flags = {i: [False, False] for i, _ in texts}
                w = words.value
                cut = broken(w, prior, texts[0][1]) if prior and texts else (False, "", "")
                head = _part(w, cut, 1)
                for k, (i, t) in enumerate(texts):
                    cut = broken(w, t, texts[k + 1][1] if k + 1 < len(texts) else after)
                    flags[i][0] = cut[0]
                    found = _tokens(t)
                    for n, (_, word) in enumerate(found):
                        if n == 0 and head is not None or n == len(found) - 1 and cut[0]:
                            continue  # a part of a broken word
                        for part in word.split("-") if w.source(word) is None and "-" in word else [word]:
                            if w.source(part):
                                flags[i][1] = True
                                break
                    if head or _part(w, cut, 0):
                        flags[i][1] = True
                    head = _part(w, cut, 1)
                out.append([{"line_index": i, "broken": f[0], "misread": f[1]} for i, f in flags.items()])
            yield b.assign(flags=out)

    return full.unionByName(bare).mapInPandas(run, _ddl(full) + ", flags array<struct<line_index:int,broken:boolean,misread:boolean>>")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _part(words: Words, cut: tuple[bool, str, str], side: int) -> bool | None:
    """Whether the misread letter of a broken word is in the part on that side; None if the line end breaks no word."""
    if not cut[0]:
        return None
    got = words.source(cut[1] + cut[2])
    if not got:
        return False
    return any((at < len(cut[1])) == (side == 0) for at in _differs(got[0], (cut[1] + cut[2]).lower()))


def _differs(known: str, read: str) -> list[int]:
    out, i, j, reads = [], 0, 0, _reads()
    while i < len(known) and j < len(read):
        if known[i] == read[j]:
            i, j = i + 1, j + 1
            continue
        r = next((r for r in reads.get(known[i], ()) if read.startswith(r, j) and spelt_rest(known, read, i + 1, j + len(r))), None)
        if r is None:
            return out or [j]
        out.append(j)
        i, j = i + 1, j + len(r)
    return out


def spelt_rest(known: str, read: str, i: int, j: int) -> bool:
    return known[i:] == read[j:] or spelt(known[i:], read[j:]) is not None


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = marked(table(spark, sf_dir, "ocr_pages"), Scratch(spark, "pages"))
    furniture = F.transform("furniture", lambda i: F.struct(i.alias("line_index"), F.lit("furniture").alias("defect")))
    named = lambda flag, name: F.transform(F.filter("flags", lambda x: x[flag]), lambda x: F.struct(x["line_index"].alias("line_index"), F.lit(name).alias("defect")))
    return got.select("page_no", F.explode(F.concat(furniture, named("broken", "broken_word"), named("misread", "misread"))).alias("d")).select("page_no", "d.line_index", "d.defect").distinct()


def paragraphs(marked_pages: DataFrame, scratch: Scratch, words=None) -> DataFrame:
    """The running text: one row per paragraph, at the page and line where it begins. A line that is indented against its
    page's usual margin begins a paragraph; what stands above the first such line goes on from the page before. A page without
    such a line is a paragraph of its own, which the head of the next page may go on, so that none grows beyond two pages."""

    def run(batches):
        for b in batches:
            rows = []
            for no, work, lines, furniture, flags in zip(b["page_no"], b["work_family"], b["lines"], b["furniture"], b["flags"], strict=True):
                drop, broken_at = set(furniture), {x["line_index"] for x in flags if x["broken"]}
                texts = [x for x in lines if x["line_index"] not in drop and x["text"].strip()]
                lefts = sorted(x["left"] for x in texts)
                margin = lefts[(len(lefts) - 1) // 2] if lefts else 0
                start, k = None, 0
                for x in texts:
                    if x["left"] >= margin + 20:
                        start = x["line_index"]
                    t = x["text"].strip()
                    join = x["line_index"] in broken_at
                    if join and t[-1:] in HYPHENS:
                        t = t[:-1]
                    rows.append((no, work, start, k, x["line_index"], " ".join(t.split()), join))
                    k += 1
            yield pd.DataFrame(rows, columns=["page_no", "work_family", "start", "k", "line_index", "text", "joins"]).astype({"start": "Int64"})

    schema = "page_no bigint, work_family string, start int, k int, line_index int, text string, joins boolean"
    lines = scratch.keep(marked_pages.select("page_no", "work_family", "lines", "furniture", "flags").mapInPandas(run, schema))
    pages = lines.groupBy("work_family", "page_no").agg(F.max_by(F.struct("page_no", F.col("start").alias("line")), F.when(F.col("start").isNotNull(), F.col("k"))).alias("own"), F.min("line_index").alias("top"))
    top = F.struct("page_no", F.col("top").alias("line"))
    pages = with_order(pages.withColumn("bare", F.col("own").isNull()).withColumn("own", F.coalesce("own", top)), {"prior": ("own", "before")})
    pages = pages.withColumn("prior", F.when(F.col("bare"), top).otherwise(F.coalesce("prior", top))).select("page_no", "prior")
    at = F.when(F.col("start").isNotNull(), F.struct(F.col("page_no"), F.col("start").alias("line"))).otherwise(F.col("prior"))
    placed = lookup(lines, pages, "page_no").withColumn("at", at)
    parts = placed.groupBy("work_family", "at").agg(F.array_sort(F.collect_list(F.struct("page_no", "k", "text", "joins"))).alias("parts"))
    text = F.aggregate("parts", F.lit(""), lambda acc, x: F.concat(acc, x["text"], F.when(x["joins"], "").otherwise(" ")), lambda acc: F.trim(acc))
    return parts.select(F.nullif("work_family", F.lit("")).alias("work_family"), F.col("at.page_no").alias("page_no"), F.col("at.line").alias("line_index"), F.size("parts").alias("lines"), text.alias("text"))


def p1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pages")
    return paragraphs(scratch.keep(marked(table(spark, sf_dir, "ocr_pages"), scratch)), scratch)


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per work: pages and lines with each defect."""
    got = marked(table(spark, sf_dir, "ocr_pages"), Scratch(spark, "pages"))
    count = lambda flag: F.sum(F.size(F.filter("flags", lambda x: x[flag])))
    return got.groupBy("work_family").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.size("lines")).alias("lines"), F.sum(F.size("furniture")).alias("furniture"), count("broken").alias("broken_word"), count("misread").alias("misread"))


QUERIES = {"p1_found": p1_found, "p1_paragraphs": p1_paragraphs, "p1_report": p1_report}
