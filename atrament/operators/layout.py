"""Layout: conflicts of boxes, consensus of teachers, matching to ground truth, reading order, line gates.

Steps that depend on the order of choices run per page in grouped Arrow functions; a page is a bounded group.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atrament.functions import geometry as G
from atrament.session import Scratch, lookup, numbered


def conflicts(boxes: DataFrame, page: str, key: str, box: str, iou: float = 0.5, inside: float = 0.9) -> DataFrame:
    """Pairs of boxes of a page that overlap by IoU or containment. Boxes meet in the grid cells they share, so a crowded
    page costs what its neighbours cost."""
    b = F.col(box)
    step = 256
    cells = lambda lo, hi: F.sequence(F.floor(b[lo] / step).cast("int"), F.greatest(F.floor((b[hi] - 1) / step), F.floor(b[lo] / step)).cast("int"))
    grid = boxes.where((b[2] > b[0]) & (b[3] > b[1])).select(page, key, box, F.explode(cells(0, 2)).alias("cx"), cells(1, 3).alias("ys")).select(page, key, box, "cx", F.explode("ys").alias("cy"))
    x = grid.select(page, "cx", "cy", F.col(key).alias("a"), F.col(box).alias("box_a"))
    y = grid.select(page, "cx", "cy", F.col(key).alias("b"), F.col(box).alias("box_b"))
    j = x.join(y, [page, "cx", "cy"]).where("a < b").withColumn("iou", G.iou(F.col("box_a"), F.col("box_b"))).withColumn("inside", G.containment(F.col("box_a"), F.col("box_b")))
    return j.where((F.col("iou") >= iou) | (F.col("inside") >= inside)).select(page, "a", "b", "iou", "inside").distinct()


def _box_iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union else 0.0


def consensus(detections: DataFrame, iou: float = 0.5, votes: int = 2) -> DataFrame:
    """detections (page_id, teacher, id, label, box, score) to clusters of one label with one vote per teacher, every pair
    of which overlaps: page_id, label, box (medians), score (mean), teachers, accepted."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: list[list] = []
        for r in pdf.sort_values(["label", "teacher", "id"]).itertuples():
            best, at = -1.0, None
            for k, g in enumerate(groups):
                if g[0].label == r.label and all(x.teacher != r.teacher for x in g):
                    least = min(_box_iou(x.box, r.box) for x in g)
                    if least >= iou and least > best:
                        best, at = least, k
            if at is None:
                groups.append([r])
            else:
                groups[at].append(r)
        rows = [(pdf["page_id"].iloc[0], g[0].label, [float(pd.Series([x.box[i] for x in g]).median()) for i in range(4)], float(sum(x.score for x in g) / len(g)), sorted(x.teacher for x in g), len(g) >= votes) for g in groups]
        return pd.DataFrame(rows, columns=["page_id", "label", "box", "score", "teachers", "accepted"])

    return detections.groupBy("page_id").applyInPandas(run, "page_id string, label string, box array<double>, score double, teachers array<string>, accepted boolean")


def match_detections(detections: DataFrame, truth: DataFrame, iou: float = 0.5) -> DataFrame:
    """Greedy matching by score within page and label: page_id, label, tp, fp, fn. Equal overlaps go to the last box."""

    def run(key, d: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        free, tp = dict(enumerate(t["box"])), 0
        for b in d.sort_values(["score", "id"], ascending=[False, True])["box"]:
            best = max(((_box_iou(b, x), k) for k, x in free.items()), default=(0.0, -1))
            if best[0] >= iou:
                tp += 1
                del free[best[1]]
        return pd.DataFrame([(*key, tp, len(d) - tp, len(t) - tp)], columns=["page_id", "label", "tp", "fp", "fn"])

    keys = ["page_id", "label"]
    return detections.groupBy(*keys).cogroup(truth.groupBy(*keys)).applyInPandas(run, "page_id string, label string, tp bigint, fp bigint, fn bigint")


def assign_regions(boxes: DataFrame, regions: DataFrame, page: str = "page_id") -> DataFrame:
    """Each box's region: the largest overlap, else the nearest centre, then the least index. A page's regions are an array
    beside each box, so nothing is multiplied out."""
    r = regions.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("region_index", "region_box"))).alias("regions"))

    def rank(x):
        b, q = F.col("box"), x["region_box"]
        dist = F.pow((b[0] + b[2] - q[0] - q[2]) / 2, 2) + F.pow((b[1] + b[3] - q[1] - q[3]) / 2, 2)
        over = G.overlap_area(b, q)
        return F.struct((-over).alias("o"), F.when(over > 0, 0.0).otherwise(dist).alias("d"), x["region_index"].alias("region_index"))

    return boxes.join(r, page, "left").withColumn("region_index", F.array_min(F.transform("regions", rank))["region_index"]).drop("regions")


def reading_order(boxes: DataFrame, columns: bool = True) -> DataFrame:
    """boxes (page_id, id, box) with their place. Rows gather boxes whose centre lies within half the median height of the
    row's running mean; columns are runs of boxes that overlap by a quarter or more across, cut at boxes that span 70 % of the page."""

    def rows_of(items: list) -> list:
        if not items:
            return []
        heights = sorted(b[3] - b[1] for _, b in items)
        tolerance = heights[len(heights) // 2] / 2
        rows: list[list] = []
        for k, b in sorted(items, key=lambda x: ((x[1][1] + x[1][3]) / 2, x[1][0])):
            centre = (b[1] + b[3]) / 2
            if rows and abs(rows[-1][0] - centre) <= tolerance:
                rows[-1][1].append((k, b))
                rows[-1][0] = sum((y[1] + y[3]) / 2 for _, y in rows[-1][1]) / len(rows[-1][1])
            else:
                rows.append([centre, [(k, b)]])
        return [k for _, r in rows for k, _ in sorted(r, key=lambda x: x[1][0])]

    def columns_of(items: list) -> list:
        groups: list[list] = []
        for k, b in items:
            touching = [g for g in groups if any(min(b[2], x[2]) - max(b[0], x[0]) >= 0.25 * min(b[2] - b[0], x[2] - x[0]) for _, x in g)]
            for g in touching:
                groups.remove(g)
            groups.append([y for g in touching for y in g] + [(k, b)])
        return [k for g in sorted(groups, key=lambda g: min(b[0] for _, b in g)) for k in rows_of(g)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items = list(zip(pdf["id"], pdf["box"], strict=True))
        if not columns:
            order = rows_of(items)
        else:
            left, right = min(b[0] for _, b in items), max(b[2] for _, b in items)
            wide = sorted((x for x in items if x[1][2] - x[1][0] >= 0.7 * (right - left)), key=lambda x: x[1][1])
            order, rest = [], [x for x in items if x[1][2] - x[1][0] < 0.7 * (right - left)]
            for k, b in wide:
                above = [x for x in rest if (x[1][1] + x[1][3]) / 2 < (b[1] + b[3]) / 2]
                order += columns_of(above) + [k]
                rest = [x for x in rest if x not in above]
            order += columns_of(rest)
        place = {k: i for i, k in enumerate(order)}
        return pdf.assign(place=[place[k] for k in pdf["id"]])[["page_id", "id", "place"]]

    return boxes.select("page_id", "id", "box").groupBy("page_id").applyInPandas(run, "page_id string, id string, place int")


def word_lines(words: DataFrame) -> DataFrame:
    """Words (page, block, paragraph, line, left, top, width, height, confidence, text) to lines: box, least confidence, text in order."""
    keys = ["page_num", "block_num", "par_num", "line_num"]
    return words.groupBy(*keys).agg(
        F.array(F.min("left"), F.min("top"), F.max(F.col("left") + F.col("width")), F.max(F.col("top") + F.col("height"))).alias("box"),
        F.min("conf").alias("min_confidence"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", "text"))), lambda x: x["text"]), " ").alias("text"),
    )


def line_gaps(lines: DataFrame, page: str, order: str, box: str) -> DataFrame:
    """The gap to the next line of the page (negative: overlap) and the crop edges midway to the neighbours."""
    w = Window.partitionBy(page).orderBy(order)
    at = lambda c, i: F.get(c, F.lit(i))
    b, n, p = ([at(c, i) for i in range(4)] for c in (F.col(box), F.lead(box).over(w), F.lag(box).over(w)))
    return lines.withColumn("gap", n[1] - b[3]).withColumn("crop_top", F.when(p[3].isNull(), b[1]).otherwise(F.floor((p[3] + b[1]) / 2).cast("int"))).withColumn("crop_bottom", F.when(n[1].isNull(), b[3]).otherwise(F.ceil((b[3] + n[1]) / 2).cast("int")))


def page_gate(lines: DataFrame, page: str, conflict: Column, matched: Column, total: Column, least: float = 0.4) -> DataFrame:
    """All or nothing: one conflict rejects the whole page; so does a coverage below ``least`` that is not zero."""
    w = Window.partitionBy(page)
    coverage = F.sum(matched).over(w) / F.nullif(F.sum(total).over(w), F.lit(0))
    out = lines.withColumn("page_conflict", F.max(F.coalesce(conflict, F.lit(False))).over(w)).withColumn("coverage", F.coalesce(coverage, F.lit(0.0)))
    return out.withColumn("accepted", ~F.col("page_conflict") & ((F.col("coverage") >= least) | (F.col("coverage") == 0)))


def page_skew(words: DataFrame, keys: list[str], page: str, x: str, y: str, most: float = 5.0) -> DataFrame:
    """A page's skew in degrees: the median of its lines' least-squares slopes; beyond ``most`` it is rejected."""
    lines = words.groupBy(page, *keys).agg(F.regr_slope(y, x).alias("slope")).where("slope is not null")
    return lines.groupBy(page).agg(F.median(F.degrees(F.atan("slope"))).alias("skew")).withColumn("rejected", F.abs("skew") > most)


def anchor_reason(text: Column, confidence: Column, found: Column) -> Column:
    """The first reason to reject a line as an anchor; null for an anchor. Confidences run to 100; ``found``: how often the text stands in its page."""
    from atrament.functions.text import first_reason

    return first_reason(
        (F.coalesce(confidence, F.lit(0.0)) < 90, "low_confidence"), ((F.char_length(text) < 20) | (F.size(F.split(F.trim(text), r"\s+")) < 3), "too_short"), (~text.rlike(r"\p{Ll}"), "not_line_like"), (text.rlike(r"[�\p{Co}]"), "invalid_glyph"), (F.coalesce(found, F.lit(0)) != 1, "not_unique"),
    )


def occurrences(text: Column, page_text: Column) -> Column:
    """How often a text stands in a page's text at word boundaries."""
    quoted = F.regexp_replace(text, r"([\\\[\](){}.*+?^$|#&~-])", r"\\$1")
    return F.regexp_count(page_text, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), quoted, F.lit(r"(?![\p{L}\p{N}])")))


def coco(objects: DataFrame, pages: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations and categories with dense ids in the order of their keys."""
    number = lambda df, *keys: numbered(df, [F.col(k) for k in keys], "id", scratch)
    images = number(pages.select("page_id", "file_name", "width", "height").distinct(), "page_id")
    categories = number(objects.select(F.col("label").alias("name")).distinct(), "name")
    b = [F.get("box", F.lit(i)) for i in range(4)]
    notes = objects.join(images.select("page_id", F.col("id").alias("image_id")), "page_id")
    notes = lookup(notes, categories.select(F.col("name").alias("label"), F.col("id").alias("category_id")), "label", "inner")
    notes = notes.select("image_id", "category_id", F.array(b[0], b[1], b[2] - b[0], b[3] - b[1]).alias("bbox"), G.area(F.col("box")).alias("area"), F.lit(0).alias("iscrowd"))
    return images, number(notes, "image_id", "category_id", "bbox"), categories
