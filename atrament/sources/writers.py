"""Sinks: line-wise JSON, tab-separated packs, reports, releases; nothing is overwritten unless asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrament.functions.text import escape_cell, unescape_cell


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).option("lineSep", "\n").text(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def pack_cells(order: DataFrame, predictions: DataFrame, payload: str = "text") -> DataFrame:
    """order (pos, id) and predictions (id, status, payload) to (pos, cell): escaped, an error is empty."""
    j = order.join(predictions.select("id", "status", F.col(payload).alias("p")), "id", "left")
    return j.select("pos", F.when(F.col("status") == "ok", escape_cell(F.coalesce("p", F.lit("")))).otherwise("").alias("cell")).orderBy("pos")


def unpack_cells(order: DataFrame, cells: DataFrame) -> DataFrame:
    """The inverse by position: pos, id, text. A position of one side only raises."""
    j = order.join(cells, "pos", "full")
    ok = F.when(F.col("id").isNotNull() & F.col("cell").isNotNull(), unescape_cell(F.col("cell"))).otherwise(F.raise_error(F.lit("rows do not align")))
    return j.select("pos", "id", ok.alias("text"))


def sorted_json(col: Column) -> Column:
    """A map as compact JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(col))))


def report_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a Markdown table."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |")).alias("line"))


def labelled_union(parts: dict[str, DataFrame], label: str = "subset") -> DataFrame:
    """All parts with their names; columns that one lacks are null."""
    out = None
    for name, df in parts.items():
        x = df.withColumn(label, F.lit(name))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def release(splits: dict[str, DataFrame], roles: dict[str, str], secret: list[str], root: str, key: str = "id") -> None:
    """Writes each split by its role: public whole, private without the secret columns, ids as keys only."""
    for name, df in splits.items():
        role = roles[name]
        out = df if role == "public" else df.drop(*secret) if role == "private" else df.select(key)
        out.write.mode("errorifexists").parquet(f"{root}/{name}")
