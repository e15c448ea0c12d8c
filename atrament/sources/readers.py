"""Sources: strict line-wise JSON, word tables, page XML, ALTO, image and text pairs, archives."""

from __future__ import annotations

import tarfile
import zipfile
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atrament.functions.arrow import arrow
from atrament.functions.geometry import polygon_box


def jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """One object per line, split at line feeds only, so that other separators may stand in texts. Strict reading raises on
    a line that is no object, holds a key twice or NaN; otherwise such lines are null rows. Adds source_path."""
    raw = spark.read.option("lineSep", "\n").text(paths).select(F.col("value"), F.col("_metadata.file_path").alias("source_path")).where("trim(value) <> ''")
    parsed = F.try_parse_json(F.regexp_replace("value", r"\r$", ""))
    good = parsed.isNotNull() & (F.schema_of_variant(parsed).startswith("OBJECT"))
    line = F.when(good, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a strict JSON object: "), F.substring("value", 1, 80)))) if strict else F.when(good, F.col("value"))
    return raw.select(F.from_json(line, schema if isinstance(schema, str) else schema.simpleString()).alias("r"), "source_path").select("r.*", "source_path")


WORDS = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"


def word_table(spark: SparkSession, path: str, width: int | None = None, height: int | None = None) -> DataFrame:
    """Level-5 words of recognition tables; a word with a confidence or box out of range raises."""
    df = spark.read.option("sep", "\t").option("header", True).option("quote", "").schema(WORDS).csv(path).where("level = 5 and trim(text) <> ''")
    ok = F.col("conf").between(0, 100) & (F.col("left") >= 0) & (F.col("top") >= 0) & (F.col("width") > 0) & (F.col("height") > 0)
    if width and height:
        ok &= (F.col("left") + F.col("width") <= width) & (F.col("top") + F.col("height") <= height)
    return df.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("bad word "), F.col("text")))))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


_REGION = "id string, place int, points string, text string, lines int"


@arrow(f"array<struct<{_REGION.replace(' string', ':string').replace(' int', ':int')}>>")
def page_regions(xml: pd.Series) -> pd.Series:
    """Text regions of a page document in reading order; a document that does not parse has none."""

    def read(doc: str | None) -> list[dict]:
        try:
            root = ElementTree.fromstring(doc or "")
        except ElementTree.ParseError:
            return []
        order = {e.get("regionRef"): int(e.get("index", 0)) for e in root.iter() if _local(e.tag) == "RegionRefIndexed"}
        out = []
        for r in root.iter():
            if _local(r.tag) != "TextRegion":
                continue
            points = next((c.get("points") or " ".join(f"{p.get('x')},{p.get('y')}" for p in c) for c in r if _local(c.tag) == "Coords"), "")
            own = [c for c in r if _local(c.tag) == "TextEquiv"]
            lines = [c for c in r if _local(c.tag) == "TextLine"]
            said = own or [e for c in lines for e in c if _local(e.tag) == "TextEquiv"]
            text = "\n".join((u.text or "").strip() for e in said for u in e if _local(u.tag) == "Unicode")
            out.append({"id": r.get("id"), "place": order.get(r.get("id"), 1 << 30), "points": points, "text": text, "lines": len(lines)})
        return sorted(out, key=lambda x: x["place"])

    return xml.map(read)


@arrow("struct<text:string,lines:int,usable:int>")
def alto_text(xml: pd.Series) -> pd.DataFrame:
    """The text of an ALTO document, its lines, and those with content and a baseline."""
    rows = []
    for doc in xml:
        try:
            lines = [e for e in ElementTree.fromstring(doc or "").iter() if _local(e.tag) == "TextLine"]
        except ElementTree.ParseError:
            lines = []
        texts = [" ".join(s.get("CONTENT", "") for s in x if _local(s.tag) == "String").strip() for x in lines]
        rows.append(("\n".join(texts), len(lines), sum(bool(t) and x.get("BASELINE") is not None for t, x in zip(texts, lines, strict=True))))
    return pd.DataFrame(rows, columns=["text", "lines", "usable"])


def page_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per region of page documents: path, region_index, id, text, box, lines."""
    docs = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), page_regions("value").alias("r"))
    return docs.select("path", F.posexplode("r").alias("region_index", "r")).select("path", "region_index", "r.id", "r.text", polygon_box(F.col("r.points")).alias("box"), "r.lines")


def proof_level(wikitext: Column) -> Column:
    """The level of proofreading that a page of transcription names last; null without one."""
    return F.try_element_at(F.regexp_extract_all(wikitext, F.lit(r'<pagequality\s+level="(\d)"'), 1), F.lit(-1)).cast("int")


def body_text(html: Column, least: int = 150) -> Column:
    """The text of a page that has no table and at least ``least`` characters, else null."""
    from atrament.functions.text import strip_tags

    t = strip_tags(html)
    return F.when(~F.lower(html).contains("<table") & (F.char_length(t) >= least), t)


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Images with the text of the same stem: stem, image_sha256, text, text_sha256. A missing or empty side stays null."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    files = spark.read.format("binaryFile").load(folder)
    images = files.where(F.col("path").rlike(r"(?i)\.(png|jpe?g|tiff?)$")).select(stem.alias("stem"), F.sha2("content", 256).alias("image_sha256"))
    texts = files.where(F.col("path").endswith(".txt")).select(stem.alias("stem"), F.nullif(F.trim(F.decode("content", "UTF-8")), F.lit("")).alias("text"), F.sha2("content", 256).alias("text_sha256"))
    return images.join(texts, "stem", "full")


def tree_digest(spark: SparkSession, folder: str) -> DataFrame:
    """path and sha256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


@arrow("array<struct<member:string,sha256:string,safe:boolean>>")
def archive_members(content: pd.Series) -> pd.Series:
    """Members of ZIP or TAR files with checksums; unsafe names (absolute, upward, links) are marked and not read."""
    import hashlib

    def safe(name: str) -> bool:
        return bool(name) and not name.startswith(("/", "\\")) and ".." not in name.replace("\\", "/").split("/") and ":" not in name[:3]

    def read(data: bytes) -> list[dict]:
        out = []
        if zipfile.is_zipfile(BytesIO(data)):
            with zipfile.ZipFile(BytesIO(data)) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        ok = safe(i.filename) and (i.external_attr >> 28) != 0xA
                        out.append({"member": i.filename, "sha256": hashlib.sha256(z.read(i)).hexdigest() if ok else None, "safe": ok})
            return out
        with tarfile.open(fileobj=BytesIO(data)) as t:
            for m in t.getmembers():
                if not m.isdir():
                    ok = safe(m.name) and m.isreg()
                    out.append({"member": m.name, "sha256": hashlib.sha256(t.extractfile(m).read()).hexdigest() if ok else None, "safe": ok})
        return out

    return content.map(read)


def page_numbers(ranges: Column) -> Column:
    """The pages of a list like 1-3,5; anything else raises."""
    part = F.transform(F.split(ranges, r"\s*,\s*"), lambda x: F.when(x.rlike(r"^\d+(-\d+)?$"), F.sequence(F.split(x, "-")[0].cast("int"), F.element_at(F.split(x, "-"), -1).cast("int"))).otherwise(F.raise_error(F.concat(F.lit("bad page range "), x)).cast("array<int>")))
    return F.array_distinct(F.flatten(part))


def windows(df: DataFrame, order: list[str], offsets: list[int], size: int) -> DataFrame:
    """Small windows of rows at given offsets of a fixed order."""
    out = None
    for o in offsets:
        part = df.orderBy(*order).offset(o).limit(size).withColumn("offset", F.lit(o))
        out = part if out is None else out.unionByName(part)
    return out
