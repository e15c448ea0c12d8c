"""Alignments, Markdown outlines and table trees: what columns cannot express, in Arrow functions."""

from __future__ import annotations

import difflib
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd

from atrament.functions.arrow import arrow
from atrament.functions.text import QUOTES


def edit_table(a, b, cost=lambda x, y: x != y) -> list[list[float]]:
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(rows[-1][j - 1] + cost(x, y), rows[-1][j] + 1, new[-1] + 1))
        rows.append(new)
    return rows


def edit_distance(a, b) -> int:
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    a, b = a[lo:], b[lo:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@arrow("int")
def word_edits(reference: pd.Series, predicted: pd.Series) -> pd.Series:
    """Fewest word insertions, deletions and replacements."""
    return pd.Series([edit_distance((a or "").split(), (b or "").split()) for a, b in zip(reference, predicted, strict=True)], dtype="int32")


def edit_ops(a: str, b: str) -> list[tuple[str, str, str]]:
    """One minimal alignment as (op, from, to); among equals a match, then a replacement, a deletion, an insertion."""
    rows, i, j, out = edit_table(a, b), len(a), len(b), []
    while i or j:
        if i and j and a[i - 1] == b[j - 1] and rows[i][j] == rows[i - 1][j - 1]:
            out.append(("match", a[i - 1], b[j - 1]))
            i, j = i - 1, j - 1
        elif i and j and rows[i][j] == rows[i - 1][j - 1] + 1:
            out.append(("replace", a[i - 1], b[j - 1]))
            i, j = i - 1, j - 1
        elif i and rows[i][j] == rows[i - 1][j] + 1:
            out.append(("delete", a[i - 1], ""))
            i -= 1
        else:
            out.append(("insert", "", b[j - 1]))
            j -= 1
    return out[::-1]


def error_class(a: str, b: str) -> str:
    """The kind of a differing pair of characters, of which one may be empty; the first that holds of: a private character
    in the reference, a long or round s, case, diacritics, punctuation, a blank, other."""
    bare = lambda c: "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn").lower()
    if a and unicodedata.category(a) == "Co":
        return "private_use_reference"
    if {a, b} & {"ſ", "s"}:
        return "long_s_or_s"
    if a and b and a.lower() == b.lower():
        return "case_only"
    if a and b and bare(a) == bare(b):
        return "diacritic"
    if any(c and unicodedata.category(c)[0] == "P" for c in (a, b)):
        return "punctuation"
    return "whitespace" if " " in (a, b) else "other"


@arrow("array<struct<op:string,a:string,b:string,kind:string>>")
def errors_of(reference: pd.Series, predicted: pd.Series) -> pd.Series:
    """The differing places of an alignment with their kinds."""
    return pd.Series([[{"op": o, "a": x, "b": y, "kind": error_class(x, y)} for o, x, y in edit_ops(r or "", p or "") if o != "match"] for r, p in zip(reference, predicted, strict=True)])


@arrow("array<struct<a:string,b:string,before:string,after:string>>")
def mismatch_spans(reference: pd.Series, predicted: pd.Series) -> pd.Series:
    """Differing spans with 35 characters of context."""
    out = []
    for r, p in zip(reference, predicted, strict=True):
        r, p = r or "", p or ""
        ops = difflib.SequenceMatcher(None, r, p, autojunk=False).get_opcodes()
        out.append([{"a": r[i:j], "b": p[k:m], "before": r[max(0, i - 35) : i], "after": r[j : j + 35]} for o, i, j, k, m in ops if o != "equal"])
    return pd.Series(out)


@arrow("array<struct<at:int,kind:string,context:string>>")
def text_issues(texts: pd.Series) -> pd.Series:
    """Replacement, private and control characters and text that is not composed, with offsets in UTF-16 units."""
    out = []
    for t in texts:
        found = []
        for i, c in enumerate(t or ""):
            kind = "replacement" if c == "�" else {"Co": "private", "Cc": "control"}.get(unicodedata.category(c)) if c not in "\t\n\r" else None
            if kind:
                found.append({"at": len(t[:i].encode("utf-16-le", "surrogatepass")) // 2, "kind": kind, "context": t[max(0, i - 22) : i + 23]})
        if t and unicodedata.normalize("NFC", t) != t:
            found.append({"at": 0, "kind": "not_composed", "context": t[:23]})
        out.append(found)
    return pd.Series(out)


_HEAD, _ITEM = re.compile(r"(#{1,6})\s+(.*)\Z"), re.compile(r"\s*(?:[-*+]|\d+[.)])\s+(.*)\Z")
_STRAIGHT = str.maketrans(*QUOTES)


def _plain(text: str) -> str:
    return " ".join(unicodedata.normalize("NFC", text).translate(_STRAIGHT).split())


def outline(text: str | None) -> list[tuple[str, str]]:
    """Headings, list items and other lines of a Markdown text in order, each with its normalized text; empty ones are left out."""
    out = []
    for line in (text or "").splitlines():
        line = line.rstrip()
        if head := _HEAD.match(line):
            part = f"h{len(head[1])}", head[2].strip().lstrip("#")
        elif item := _ITEM.match(line):
            part = "li", item[1]
        else:
            part = "p", line.strip().strip("`")
        if _plain(part[1]):
            out.append((part[0], _plain(part[1])))
    return out


def _similarity(x: list[tuple[str, str]], y: list[tuple[str, str]]) -> float:
    if not x and not y:
        return 1.0
    cost = lambda p, q: 1.0 if p[0] != q[0] else 1 - difflib.SequenceMatcher(None, p[1], q[1]).ratio()
    return max(0.0, 1 - edit_table(x, y, cost)[-1][-1] / max(len(x), len(y)))


def outline_similarity(a: str | None, b: str | None) -> float:
    """1 - weighted edits / longer outline; replacing a part of the same kind costs what their texts differ."""
    return _similarity(outline(a), outline(b))


@arrow("array<struct<kind:string,reference:int,predicted:int,similarity:double>>")
def outline_report(reference: pd.Series, predicted: pd.Series) -> pd.Series:
    """Per kind of part: how many both sides have, and how similar they are."""
    out = []
    for a, b in zip(reference, predicted, strict=True):
        x, y = outline(a), outline(b)
        one = lambda side, k: [p for p in side if p[0] == k]
        out.append([{"kind": k, "reference": len(one(x, k)), "predicted": len(one(y, k)), "similarity": _similarity(one(x, k), one(y, k))} for k in sorted({k for k, _ in x + y})])
    return pd.Series(out)


@arrow("double")
def structure_similarity(reference: pd.Series, predicted: pd.Series) -> pd.Series:
    return pd.Series([outline_similarity(a, b) for a, b in zip(reference, predicted, strict=True)], dtype="float64")


@arrow("array<struct<kind:string,text:string>>")
def outline_rows(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "text": t} for k, t in outline(x)] for x in texts])


class _Tables(HTMLParser):
    """Collects tables as nested lists [tag, (rowspan, colspan), text, children]; wrappers inside a table vanish."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["forest", (1, 1), "", []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.handle_data(" ")
        if tag not in ("table", "tr", "td", "th"):
            return
        if tag in ("tr", "td", "th"):
            while len(self.open) > 1 and self.open[-1][0] in (("td", "th") if tag in ("td", "th") else ("td", "th", "tr")):
                self.open.pop()
        got = dict(attrs)
        span = tuple(int(v) if (v := got.get(k) or "").isdigit() and int(v) > 0 else 1 for k in ("rowspan", "colspan"))
        node = [tag, span, "", []]
        self.open[-1][3].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        if tag in ("table", "tr", "td", "th") and any(n[0] == tag for n in self.open[1:]):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.open[-1][0] in ("td", "th"):
            self.open[-1][2] += data


def table_tree(html: str | None) -> list | None:
    """The forest of tables; None without any."""
    p = _Tables()
    p.feed(html or "")
    p.close()
    return p.root if p.root[3] else None


def _flat(root: list) -> tuple[list, list[int], list[int]]:
    """Nodes in post-order, each one's left-most leaf, and the key roots."""
    nodes, left = [], []

    def walk(node) -> int:
        first = None
        for child in node[3]:
            at = walk(child)
            first = at if first is None else first
        nodes.append(node)
        left.append(len(nodes) - 1 if first is None else first)
        return left[-1]

    walk(root)
    return nodes, left, sorted({l: i for i, l in enumerate(left)}.values())


def tree_distance(a: list, b: list, cost) -> float:
    """Edit distance of ordered trees by dynamic programming over key roots; inserting and deleting cost one."""
    x, lx, kx = _flat(a)
    y, ly, ky = _flat(b)
    full = [[0.0] * len(y) for _ in x]
    for i in kx:
        for j in ky:
            m, n, oi, oj = i - lx[i] + 2, j - ly[j] + 2, lx[i] - 1, ly[j] - 1
            part = [[0.0] * n for _ in range(m)]
            for p in range(1, m):
                part[p][0] = part[p - 1][0] + 1
            for q in range(1, n):
                part[0][q] = part[0][q - 1] + 1
            for p in range(1, m):
                for q in range(1, n):
                    whole = lx[p + oi] == lx[i] and ly[q + oj] == ly[j]
                    swap = part[p - 1][q - 1] + cost(x[p + oi], y[q + oj]) if whole else part[lx[p + oi] - 1 - oi][ly[q + oj] - 1 - oj] + full[p + oi][q + oj]
                    part[p][q] = min(part[p - 1][q] + 1, part[p][q - 1] + 1, swap)
                    if whole:
                        full[p + oi][q + oj] = part[p][q]
    return full[-1][-1]


def table_similarity(reference: str | None, predicted: str | None, structure_only: bool = False) -> float:
    """1 - tree edits / larger tree; both without tables 1, one of them 0."""
    a, b = table_tree(reference), table_tree(predicted)
    if a is None or b is None:
        return float(a is None and b is None)

    def cost(p, q) -> float:
        if p[0] != q[0] or p[0] in ("td", "th") and p[1] != q[1]:
            return 1.0
        if structure_only or p[0] not in ("td", "th") or p[3] or q[3]:
            return 0.0  # cells that hold tables are told by those
        s, t = " ".join(p[2].split()), " ".join(q[2].split())
        return edit_distance(s, t) / max(len(s), len(t)) if s or t else 0.0

    return 1 - tree_distance(a, b, cost) / max(len(_flat(a)[0]), len(_flat(b)[0]))


@arrow("struct<teds:double,struct:double>")
def table_scores(reference: pd.Series, predicted: pd.Series) -> pd.DataFrame:
    pairs = list(zip(reference, predicted, strict=True))
    return pd.DataFrame({"teds": [table_similarity(a, b) for a, b in pairs], "struct": [table_similarity(a, b, True) for a, b in pairs]})


@arrow("array<string>")
def table_rows(html: pd.Series) -> pd.Series:
    """The texts of each row, cells joined by a blank; empty cells and rows are left out."""

    def cells(node):
        for c in node[3]:
            if c[0] in ("td", "th") and c[2].strip():
                yield " ".join(c[2].split())
            yield from cells(c)

    def rows(node):
        if node[0] == "tr":
            text = " ".join(cells(node))
            if text:
                yield text
        else:
            for c in node[3]:
                yield from rows(c)

    return pd.Series([list(rows(t)) if (t := table_tree(h)) else [] for h in html])
