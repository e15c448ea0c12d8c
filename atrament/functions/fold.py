"""Folding of names and lines: lower case, no diacritics, letters and digits only."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def base_letters() -> tuple[str, str]:
    """Lower-case letters that canonically decompose into one base and marks, and their bases; built by rule. ł is l."""
    src, dst = ["ł"], ["l"]
    for cp in range(0xC0, min(sys.maxunicode, 0xFFFF) + 1):
        ch = chr(cp)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and ch == ch.lower() and unicodedata.category(ch)[0] == "L" and all(unicodedata.category(x)[0] == "M" for x in parts[1:]):
            src.append(ch)
            dst.append("l" if parts[0] == "ł" else parts[0])
    return "".join(src), "".join(dst)


def fold(col: Column) -> Column:
    """Null stays null; a text without letters and digits gives the empty string."""
    return F.regexp_replace(F.translate(F.lower(col), *base_letters()), r"[^\p{L}\p{N}]+", "")


def split_name(col: Column) -> Column:
    """train, val or test in any case with outer blanks; valid and validation mean val; anything else is null."""
    s = F.lower(F.regexp_replace(col, r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""))
    return F.when(s.isin("valid", "validation"), "val").when(s.isin("train", "val", "test"), s)


def current_records(rows, columns: list[str]):
    """The row with the latest ingested_at of each id. Rows tied there are equal."""
    return rows.groupBy("id").agg(F.max_by(F.struct(*columns), F.col("ingested_at")).alias("_r")).select("id", *[F.col("_r")[c].alias(c) for c in columns])
