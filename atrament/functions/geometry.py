"""Boxes as arrays [left, top, right, bottom], hashes of images and ink profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from atrament.functions.arrow import arrow


def area(b: Column) -> Column:
    return F.greatest(F.get(b, F.lit(2)) - F.get(b, F.lit(0)), F.lit(0)) * F.greatest(F.get(b, F.lit(3)) - F.get(b, F.lit(1)), F.lit(0))


def overlap_area(a: Column, b: Column) -> Column:
    return F.greatest(F.least(F.get(a, F.lit(2)), F.get(b, F.lit(2))) - F.greatest(F.get(a, F.lit(0)), F.get(b, F.lit(0))), F.lit(0)) * F.greatest(F.least(F.get(a, F.lit(3)), F.get(b, F.lit(3))) - F.greatest(F.get(a, F.lit(1)), F.get(b, F.lit(1))), F.lit(0))


def iou(a: Column, b: Column) -> Column:
    both = overlap_area(a, b)
    union = area(a) + area(b) - both
    return F.when(union == 0, 0.0).otherwise(both / union)


def containment(a: Column, b: Column) -> Column:
    """The share of the smaller box inside the other."""
    least = F.least(area(a), area(b))
    return F.when(least == 0, 0.0).otherwise(overlap_area(a, b) / least)


def box_ok(b: Column, width: Column, height: Column) -> Column:
    inside = (F.size(b) == 4) & (F.get(b, F.lit(0)) >= 0) & (F.get(b, F.lit(1)) >= 0) & (F.get(b, F.lit(0)) < F.get(b, F.lit(2))) & (F.get(b, F.lit(1)) < F.get(b, F.lit(3))) & (F.get(b, F.lit(2)) <= width) & (F.get(b, F.lit(3)) <= height)
    return F.coalesce(inside, F.lit(False))


def clamp(b: Column, pad: int, width: Column, height: Column) -> Column:
    return F.array(F.greatest(F.get(b, F.lit(0)) - pad, F.lit(0)), F.greatest(F.get(b, F.lit(1)) - pad, F.lit(0)), F.least(F.get(b, F.lit(2)) + pad, width), F.least(F.get(b, F.lit(3)) + pad, height))


def polygon_box(points: Column) -> Column:
    """The box of a polygon written as "x,y x,y ..."."""
    p = F.transform(F.filter(F.split(points, r"\s+"), lambda x: x != ""), lambda x: F.split(x, ","))
    xs, ys = F.transform(p, lambda x: F.get(x, F.lit(0)).cast("int")), F.transform(p, lambda x: F.get(x, F.lit(1)).cast("int"))
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def rotate_box(b: Column, degrees: Column, cx: Column, cy: Column) -> Column:
    """The box around a box turned about a point."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    corners = [(F.get(b, F.lit(i)), F.get(b, F.lit(j))) for i in (0, 2) for j in (1, 3)]
    xs = F.array(*[cx + (x - cx) * c - (y - cy) * s for x, y in corners])
    ys = F.array(*[cy + (x - cx) * s + (y - cy) * c for x, y in corners])
    low, high = lambda v: F.floor(F.array_min(v)).cast("int"), lambda v: F.ceil(F.array_max(v)).cast("int")
    return F.array(low(xs), low(ys), high(xs), high(ys))


def normal_overlap(a: Column, b: Column, degrees: Column) -> Column:
    """How far two boxes overlap across the line direction; negative is a gap."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    across = lambda v: F.array(*[F.get(v, F.lit(j)) * c - F.get(v, F.lit(i)) * s for i in (0, 2) for j in (1, 3)])
    p, q = across(a), across(b)
    return F.least(F.array_max(p), F.array_max(q)) - F.greatest(F.array_min(p), F.array_min(q))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_bits(vector: Column) -> Column:
    """The signs of up to 64 numbers as one integer."""
    return F.aggregate(F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x))


@arrow("bigint")
def difference_hash(pixels: pd.Series) -> pd.Series:
    """The 64-bit gradient hash of an 8 by 9 grid of luminance."""
    out = []
    for p in pixels:
        g = np.stack([np.asarray(r) for r in p])
        bits = (g[:, 1:] > g[:, :-1]).ravel()
        out.append(int(np.packbits(bits).view(">i8")[0]))
    return pd.Series(out, dtype="int64")


@arrow("struct<ink:double,gap:int,intrusions:int>")
def ink_profile(pixels: pd.Series) -> pd.DataFrame:
    """Of a grey crop: the share of ink, the widest run of columns without ink, and runs of ink that touch the upper or lower edge."""
    rows = []
    for p in pixels:
        g = np.stack([np.asarray(r) for r in p])
        ink = g < g.mean() - g.std() * 0.5
        free = ~ink.any(0)
        cuts = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(int), [0]])))
        edge = (ink[0] | ink[-1]).astype(int)
        rows.append((float(ink.mean()), int((cuts[1::2] - cuts[::2]).max()) if len(cuts) else 0, int((np.diff(np.concatenate([[0], edge])) == 1).sum())))
    return pd.DataFrame(rows, columns=["ink", "gap", "intrusions"])


@arrow("array<int>")
def ink_band(pixels: pd.Series) -> pd.Series:
    """First and last row of the band of rows with ink; empty without ink."""
    out = []
    for p in pixels:
        g = np.stack([np.asarray(r) for r in p])
        at = np.flatnonzero((g < g.mean() - g.std() * 0.5).any(1))
        out.append([int(at[0]), int(at[-1])] if len(at) else [])
    return pd.Series(out)
