"""Where plans register their queries with the SQL that must give the same rows."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: Current line records, as a common table for the SQL twins.
CURRENT = "cur AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM printed_replay_geometry) WHERE rn = 1)"
#: A character for each place of an alphabet; the twins' distance counts bytes, so each pair gets an alphabet of its own characters, or words.
ASCII = "(" + " || ".join(f"chr({i})" for i in range(1, 128)) + ")"
BLANKS = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\p{Z}]+"


def normal_sql(c: str) -> str:
    """Composed, straight quotes, single blanks."""
    return f"""trim(regexp_replace(translate(nfc_normalize({c}), '„“”‟«»‚‘’‛‹›', '""\"\"\"\"\'\'\'\'\'\'\'\'\'\'\'\''), '{BLANKS}', ' ', 'g'))"""


def distance_sql(a: str, b: str) -> str:
    """Edit distance in code points."""
    alphabet = f"array_to_string(list_distinct(string_split({a} || {b}, '')), '')"
    return f"levenshtein(translate({a}, {alphabet}, {ASCII}), translate({b}, {alphabet}, {ASCII}))"


def word_distance_sql(a: str, b: str) -> str:
    """Edit distance in words."""
    words = lambda c: f"list_filter(string_split({c}, ' '), lambda w: w <> '')"
    one = lambda c: f"coalesce(array_to_string(list_transform({words(c)}, lambda w: chr(list_position(list_distinct(list_concat({words(a)}, {words(b)})), w))), ''), '')"
    return f"levenshtein({one(a)}, {one(b)})"


def split_sql(c: str) -> str:
    s = f"lower(trim({c}, ' \n\t\r'))"
    return f"CASE WHEN {s} IN ('valid', 'validation') THEN 'val' WHEN {s} IN ('train', 'val', 'test') THEN {s} END"
