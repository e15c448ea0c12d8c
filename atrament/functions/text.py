"""Text functions as column builders; Arrow functions only where Spark has no built-in (Unicode forms, alignments)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from atrament.functions.arrow import arrow

#: Typographic quotes and what they become.
QUOTES = ("„“”‟«»‚‘’‛‹›", "\"\"\"\"\"\"''''''")
#: Letters by which Polish text is told from others.
POLISH = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ"
VOWELS = "aeiouyąęóAEIOUYĄĘÓ"
#: Characters that clean text has not, for regular expressions.
GARBAGE = r"[@#$%^&*_=~<>|\\{}\[\]]"


@arrow("string")
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@arrow("string")
def casefold(texts: pd.Series) -> pd.Series:
    return texts.map(str.casefold, na_action="ignore")


@arrow("string")
def strip_marks(texts: pd.Series) -> pd.Series:
    """The canonical base letters; ł, which has none, stays."""
    return texts.map(lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c)[0] != "M"), na_action="ignore")


def composed(col: Column) -> Column:
    """NFC; only texts that hold a character which may compose go through Python."""
    return F.coalesce(nfc(F.when(col.rlike("[^\u0000-\u02ff\u0400-\u052f\u2010-\u2027]"), col)), col)


@arrow("string")
def value_text(texts: pd.Series) -> pd.Series:
    """normalize_v1 without case, as values of fields are compared."""
    table = str.maketrans(*QUOTES)
    return texts.map(lambda t: " ".join(unicodedata.normalize("NFC", t).translate(table).split()).casefold(), na_action="ignore")


def collapse(col: Column) -> Column:
    """Runs of blanks of any kind become one space; outer ones go."""
    return F.trim(F.regexp_replace(col, r"(?U)[\s\x{1c}-\x{1f}]+", " "))


def normalize_v0(col: Column) -> Column:
    return collapse(composed(col))


def normalize_v1(col: Column) -> Column:
    return collapse(F.translate(composed(col), *QUOTES))


def normalize_lines(col: Column) -> Column:
    """Blanks inside lines collapse, line breaks stay; empty lines go."""
    lines = F.transform(F.split(composed(col), "\n"), collapse)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length; two empty texts are equal."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def words(col: Column) -> Column:
    return F.filter(F.split(F.coalesce(col, F.lit("")), r"(?U)[\s\x{1c}-\x{1f}]+"), lambda x: x != "")


def shingles(tokens: Column, n: int) -> Column:
    """Distinct runs of n tokens; a shorter text is one shingle, an empty one has none."""
    size = F.size(tokens)
    many = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.array_distinct(F.when(size >= n, many).when(size > 0, F.array(F.array_join(tokens, " "))).otherwise(F.array().cast("array<string>")))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def noise(col: Column) -> Column:
    """0 to 1: three times the share of words without a vowel among those of four characters or more, five times that of
    garbage characters, five times that of characters beyond U+2500. A blank text is noise."""
    w = F.filter(words(col), lambda x: F.char_length(x) >= 4)
    bare = F.filter(w, lambda x: ~x.rlike(f"[{VOWELS}]"))
    share = lambda p: F.regexp_count(col, F.lit(p)) / F.char_length(col)
    raw = 3 * F.when(F.size(w) > 0, F.size(bare) / F.size(w)).otherwise(0.0) + 5 * share(GARBAGE) + 5 * share("[^\u0000-\u2500]")
    return F.when(collapse(col) == "", 1.0).otherwise(F.least(F.lit(1.0), raw))


def noise_gate(col: Column, confidence: Column, threshold: float) -> Column:
    return F.coalesce(1 - F.nullif(confidence, F.lit(float("nan"))), noise(col)) >= threshold


def low_confidence(confidence: Column, threshold: float) -> Column:
    """NaN and null are never flagged."""
    return F.coalesce(confidence < threshold, F.lit(False)) & ~F.coalesce(F.isnan(confidence), F.lit(False))


def polish_share(col: Column) -> Column:
    letters = F.regexp_count(col, F.lit(r"\p{L}"))
    return F.when(letters == 0, 0.0).otherwise(F.regexp_count(col, F.lit(f"[{POLISH}]")) / letters)


def route_language(col: Column, given: Column, forced: str | None = None, share: float = 0.02, fallback: str = "pl") -> Column:
    """A forced language, else Polish by its letters, else the given code, else the fallback."""
    if forced:
        return F.lit(forced)
    return F.when(polish_share(col) >= share, "pl").otherwise(F.coalesce(F.nullif(F.lower(F.trim(given)), F.lit("")), F.lit(fallback)))


def sentence_ok(col: Column) -> Column:
    """20 to 160 characters, 55 % letters or more, at most two brackets and four quotes."""
    n = F.char_length(col)
    count = lambda p: F.regexp_count(col, F.lit(p))
    return n.between(20, 160) & (count(r"\p{L}") >= 0.55 * n) & (count(r"[()]") <= 2) & (count("\"") <= 4)


def clean_wiki(col: Column) -> Column:
    """Without references, links' brackets and repeated blanks."""
    t = F.regexp_replace(col, r"\[\d+\]|<ref[^>]*>.*?</ref>|<ref[^>]*/>", "")
    t = F.regexp_replace(t, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    return collapse(F.regexp_replace(t, r"'{2,}", ""))


def split_sentences(col: Column) -> Column:
    return F.filter(F.split(col, r"(?<=[.!?])\s+"), lambda x: x != "")


def defect_counts(col: Column) -> dict[str, Column]:
    count = lambda p: F.regexp_count(col, F.lit(p))
    return {"chars": F.char_length(col), "tokens": F.size(words(col)), "replacement": count("\\uFFFD"), "private": count(r"\p{Co}"), "control": count(r"[\p{Cc}&&[^\t\n\r]]")}


def escape_cell(col: Column) -> Column:
    """A payload in one cell of a tab-separated file."""
    out = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    for raw, code in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def unescape_cell(col: Column) -> Column:
    """The inverse; a cell with a dangling or unknown escape raises."""
    bad = F.regexp_replace(col, r"\\[\\tnr]", "").contains("\\")
    mark = "\x00"
    out = F.replace(col, F.lit("\\\\"), F.lit(mark))
    for raw, code in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(code), F.lit(raw))
    return F.when(bad, F.raise_error(F.lit("unknown escape in a cell"))).otherwise(F.replace(out, F.lit(mark), F.lit("\\")))


def replace_once(col: Column, before: Column, after: Column) -> Column:
    """The text with ``before`` replaced where it occurs exactly once, else null."""
    times = (F.char_length(col) - F.char_length(F.replace(col, before, F.lit("")))) / F.char_length(before)
    return F.when((F.char_length(before) > 0) & (times == 1), F.replace(col, before, after))


def map_glyphs(col: Column, glyphs: dict[str, str]) -> Column:
    """Each character as the map has it, all at once, so that no replacement is replaced again."""
    table = F.create_map(*[F.lit(x) for kv in glyphs.items() for x in kv])
    return F.when(F.lit(not glyphs), col).otherwise(F.array_join(F.transform(F.split(col, ""), lambda c: F.coalesce(table[c], c)), ""))


def strip_tags(col: Column) -> Column:
    t = F.regexp_replace(col, r"(?is)<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6])>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for code, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(code), F.lit(ch))
    return normalize_lines(t)


def payload_text(col: Column) -> Column:
    """What a fenced block holds, else the text."""
    inner = F.regexp_extract(col, r"(?s)```[a-zA-Z]*\s*\n(.*?)\n?```", 1)
    return F.trim(F.when(inner != "", inner).otherwise(col))


def payload_table(col: Column, k: int = 1) -> Column:
    """The k-th HTML table of an answer, null if there are fewer."""
    return F.try_element_at(F.regexp_extract_all(col, F.lit(r"(?is)(<table\b.*?</table>)"), 1), F.lit(k))


@arrow("string")
def payload_json(texts: pd.Series) -> pd.Series:
    """The first JSON object of a text, nested however deep; null if there is none."""
    import json

    read = json.JSONDecoder().raw_decode

    def first(t):
        at = t.find("{")
        while at >= 0:
            try:
                return t[at : read(t, at)[1]]
            except (ValueError, RecursionError):
                at = t.find("{", at + 1)
        return None

    return texts.map(first, na_action="ignore")


def scale_box(box: Column, width: Column, height: Column) -> Column:
    """A box on a 0..1000 grid in pixels."""
    return F.transform(box, lambda x, i: F.round(x * F.when(i % 2 == 0, width).otherwise(height) / 1000).cast("int"))


def longest_run(items: Column) -> Column:
    """Length of the longest run of equal neighbours in an array."""
    state = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, x):
        run = F.when(acc["last"].eqNullSafe(x), acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(items, state, step, lambda acc: acc["best"])


def repetition(col: Column, chars: int = 64, tokens: int = 32, lines: int = 4) -> dict[str, Column]:
    """Flags of degenerate output: long runs of one character that is no blank, of one word, of one line."""
    return {
        "char_run": F.coalesce(col.rlike(rf"(?U)(\S)\1{{{chars - 1},}}"), F.lit(False)),
        "word_run": F.coalesce(longest_run(F.regexp_extract_all(col, F.lit(r"(?U)(\w+)"), 1)) >= tokens, F.lit(False)),
        "line_run": F.coalesce(longest_run(F.filter(F.transform(F.split(col, r"\R"), lambda x: F.trim(x)), lambda x: x != "")) >= lines, F.lit(False)),
    }


def triage(col: Column, finish: Column) -> Column:
    """Flags that send a page to review."""
    flags = {"token_limit": finish == "length", "no_end": finish.isNull(), "image_tag": col.rlike(r"(?i)<img\b|!\[[^\]]*\]\("), "cyrillic": col.rlike(r"\p{IsCyrillic}")}
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items()]))


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds; null if none does. A null condition does not hold."""
    out = F.lit(None).cast("string")
    for cond, name in reversed(rules):
        out = F.when(F.coalesce(cond, F.lit(False)), F.lit(name)).otherwise(out)
    return out
