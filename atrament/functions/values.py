"""Typed values of document fields: dates, money, identifiers; a value that does not parse stays as collapsed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from atrament.functions.arrow import let
from atrament.functions.fold import base_letters
from atrament.functions.text import collapse, value_text

#: Names of the months in Polish without diacritics, nominative and genitive.
MONTHS = [("styczen", "stycznia"), ("luty", "lutego"), ("marzec", "marca"), ("kwiecien", "kwietnia"), ("maj", "maja"), ("czerwiec", "czerwca"), ("lipiec", "lipca"), ("sierpien", "sierpnia"), ("wrzesien", "wrzesnia"), ("pazdziernik", "pazdziernika"), ("listopad", "listopada"), ("grudzien", "grudnia")]
#: Weights of the check digits of tax and personal numbers.
NIP_WEIGHTS, PESEL_WEIGHTS = [6, 5, 7, 2, 3, 4, 5, 6, 7], [1, 3, 7, 9, 1, 3, 7, 9, 1, 3]


def _valid(y: Column, m: Column, d: Column) -> Column:
    return F.date_format(F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")


def _date(text: Column) -> Column:
    """Year first or day first with dashes, dots or slashes, or with the month's name; null for another form or no such day."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.translate(text, *base_letters()), r"\s*r\.?$", ""), r"\.+$", ""))
    iso, day_first, named = r"^(\d{4})[-./](\d{1,2})[-./](\d{1,2})$", r"^(\d{1,2})[-./](\d{1,2})[-./](\d{4})$", r"^(\d{1,2})\s+([a-z]+)\s+(\d{4})$"

    def day(t: Column) -> Column:
        pick = lambda p, k: F.regexp_extract(t, p, k)
        month = F.coalesce(*[F.when(pick(named, 2).isin(*names), F.lit(str(i))) for i, names in enumerate(MONTHS, 1)])
        return F.when(t.rlike(iso), _valid(pick(iso, 1), pick(iso, 2), pick(iso, 3))).when(t.rlike(day_first), _valid(pick(day_first, 3), pick(day_first, 2), pick(day_first, 1))).when(t.rlike(named), _valid(pick(named, 3), month, pick(named, 1)))

    return let(bare, day)


def _money(text: Column) -> Column:
    """The amount as plain decimal text without trailing zeros; null if it is none. Of two different marks the last is
    decimal; marks before each three digits group them. Minus zero is zero."""
    clean = F.regexp_replace(F.regexp_replace(text, r",\s*-\s*$", ".00"), r"\s*(?:zł\.?|pln)\s*", "")
    clean = F.regexp_replace(clean, r"[ '\x{2019}]", "")

    def amount(t: Column) -> Column:
        u = F.regexp_replace(t, r"^[+-]", "")
        last = F.regexp_extract(u, r"([.,])[^.,]*$", 1)
        both = u.contains(".") & u.contains(",")
        plain = F.when(both & (last == ","), F.translate(u, ",.", ".")).when(both, F.translate(u, ",", "")).when(u.rlike(r"^\d{1,3}(?:,\d{3})+$|^\d{1,3}(?:\.\d{3})+$"), F.translate(u, ",.", "")).otherwise(F.translate(u, ",", "."))
        tidy = let(plain, lambda x: F.when(x.rlike(r"^\d+(?:\.\d+)?$"), F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^0+(?=\d)", ""), r"(\.\d*?)0+$", "$1"), r"\.$", "")))
        return let(tidy, lambda x: F.concat(F.when(t.startswith("-") & (x != "0"), "-").otherwise(""), x))

    return let(clean, amount)


def _digits(text: Column, length: int) -> Column:
    d = F.regexp_replace(text, r"\D", "")
    return F.when(F.char_length(d) == length, d)


def date_value(col: Column) -> Column:
    return let(value_text(col), lambda t: F.coalesce(_date(t), t))


def money_value(col: Column) -> Column:
    return let(value_text(col), lambda t: F.coalesce(_money(t), t))


def digits_value(col: Column, length: int) -> Column:
    return let(value_text(col), lambda t: F.coalesce(_digits(t, length), t))


def address_value(col: Column) -> Column:
    return collapse(F.regexp_replace(value_text(col), r"[^\p{L}\p{N}_\s-]", " "))


def field_value(col: Column, kind: Column) -> Column:
    """The form in which values of a kind are compared: without case, with straight quotes and single blanks; what does not
    parse as its kind stays such text."""
    typed = lambda t: F.when(kind == "date", _date(t)).when(kind == "money", _money(t)).when(kind == "nip", _digits(t, 10)).when(kind == "pesel", _digits(t, 11)).when(kind == "address", collapse(F.regexp_replace(t, r"[^\p{L}\p{N}_\s-]", " ")))
    return let(value_text(col), lambda t: F.coalesce(typed(t), t))


def verdict(reference: Column, predicted: Column) -> Column:
    """absent, missing, spurious, match or mismatch; an empty value is none."""
    r, p = F.nullif(reference, F.lit("")), F.nullif(predicted, F.lit(""))
    return F.when(r.isNull() & p.isNull(), "absent").when(p.isNull(), "missing").when(r.isNull(), "spurious").when(r == p, "match").otherwise("mismatch")


def check_digit(digits: Column, weights: list[int], kind: str) -> Column:
    """The last digit that a tax number (modulo 11, null for ten) or a personal number (modulo 10) must have."""
    total = sum((F.substring(digits, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))
    return F.when(total % 11 < 10, total % 11) if kind == "nip" else (10 - total % 10) % 10


def hash_bucket(key: Column, buckets: int = 10) -> Column:
    """The first eight hex digits of the key's SHA-256, modulo the number of buckets."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") % buckets


def index_percentile(values: Column, p: float) -> Column:
    """The element at int(p * n) of the sorted array, the last one at most."""
    s = F.array_sort(values)
    return F.element_at(s, (F.least(F.size(s) - 1, F.floor(F.lit(p) * F.size(s))) + 1).cast("int"))


def event_time(col: Column) -> Column:
    """A timestamp with an offset; null without one."""
    return F.when(col.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(col))


def money_text(amount: Column) -> Column:
    """Half up, two decimals, comma, thin groups: 1 234,56 zł."""
    return F.concat(F.translate(F.format_number(F.round(amount, 2), 2), ",.", " ,"), F.lit(" zł"))
