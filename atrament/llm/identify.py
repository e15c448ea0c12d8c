"""A language identifier, trained on the labelled documents themselves: naive Bayes over letter n-grams within words.

It is fitted on a bounded sample, at most PER_LANGUAGE whole documents of each language code of two or three letters in hashed order. As codes may
be wrong and texts mixed, the sample is labelled again by the first model, paragraph by paragraph, and the model refitted.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atrament.llm.languages import language

#: The bound of the sample the classifier is fitted on: documents of each code.
PER_LANGUAGE = 300
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def _grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1) if w[i : i + n] not in ("^", "$")]


def words_of(text: str) -> list[str]:
    """Words in lower case without likely names: capitalised words that do not open a sentence are left out where others remain."""
    found, names = [], []
    for m in _WORD.finditer(text):
        w = m[0]
        before = text[: m.start()].rstrip()[-1:] if w[:1].isupper() else ""
        (names if w[:1].isupper() and before not in ("", ".", "!", "?", "…", ":", "„", "“", "»", "«", '"') and len(w) > 1 and not w.isupper() else found).append(w.lower())
    return found or names


class Identifier:
    def __init__(self, counts: dict[str, Counter]):
        self.counts = counts
        self.languages = sorted(counts)
        grams: dict[str, int] = {}
        for c in counts.values():
            for g in c:
                grams.setdefault(g, len(grams))
        table = np.full((len(grams) + 1, len(counts)), 0.5)
        for k, x in enumerate(self.languages):
            for g, n in counts[x].items():
                table[grams[g], k] += n
        self.grams, self.table = grams, np.log(table) - np.log(np.array([sum(counts[x].values()) for x in self.languages]) + 0.5 * len(grams) + 1)
        self.memo: dict[str, tuple[int, np.ndarray]] = {}

    def __getstate__(self):
        return self.counts

    def __setstate__(self, counts):
        self.__init__(counts)

    def _word(self, w: str) -> tuple[int, np.ndarray]:
        got = self.memo.get(w)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            at = [self.grams.get(g, -1) for g in _grams(w[:60])]
            got = self.memo[w] = (len(at), self.table[at].sum(0))
        return got

    def rank(self, text: str) -> list[tuple[float, str]]:
        """Mean log-likelihoods per n-gram, best first; empty without words or languages."""
        return self.rank_words(words_of(text))

    def rank_words(self, words: list[str]) -> list[tuple[float, str]]:
        found = [self._word(w) for w in words]
        n = sum(k for k, _ in found)
        if not n or not self.languages:
            return []
        return sorted(zip((np.sum([v for _, v in found], axis=0) / n).tolist(), self.languages, strict=True), reverse=True)

    def __call__(self, text: str, margin: float = 0.25, least: int = 8) -> str | None:
        """The language, or None where the text is too short (letters of the Latin script count once, others threefold) or the two best are too close."""
        r = self.rank(text)
        size = sum(1 if c < "\u0370" else 3 for c in text if c.isalpha())
        if not r or size < least or len(r) > 1 and r[0][0] - r[1][0] < margin:
            return None
        return r[0][1]


def _count(texts: list[tuple[str, list[str]]]) -> dict[str, Counter]:
    """N-grams by language; each different word is cut once."""
    seen: dict[str, Counter] = defaultdict(Counter)
    for lang, words in texts:
        seen[lang].update(words)
    counts: dict[str, Counter] = {}
    for lang, words in seen.items():
        c = counts[lang] = Counter()
        for w, n in words.items():
            for g in _grams(w):
                c[g] += n
    return counts


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE) -> Identifier:
    rows = documents.where("text is not null and lang is not null").select(language(F.col("lang")).alias("lang"), "text", F.xxhash64("doc_id", "text").alias("h"))
    first = rows.where("lang <> 'und' and lang rlike '^[a-z]{2,3}$'").withColumn("r", F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h"))).where(F.col("r") <= per_language)
    top = first.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= per_language).select("lang", "text").collect()  # at most per_language rows of each code
    parts = [(r.lang, _WORD.findall(p.lower()), words_of(p)) for r in top for p in regex.split(r"\n\s*\n", r.text) if p.strip()]
    fitted = lambda: Identifier(_count([(x, w) for x, w, _ in parts]))
    model = fitted()
    for _ in range(2):
        parts = [((model.rank_words(v) or [(0.0, x)])[0][1], w, v) for x, w, v in parts]
        model = fitted()
    return model
