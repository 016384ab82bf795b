"""Rectangles in page shares (x, y, w, h from 0 to 1) as Spark struct expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATCH = 28  # pixels a side of an image patch that costs one token
DESCENT = 0.8  # a child smaller than this share of its parent narrows the view


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))


def area(r: Column) -> Column:
    return r["w"] * r["h"]


def clamp(r: Column) -> Column:
    """The part of a rectangle that is on the page (sides may fall to 0 or below: see ``valid``)."""
    x, y = F.greatest(r["x"], F.lit(0.0)), F.greatest(r["y"], F.lit(0.0))
    return rect(x, y, F.least(r["x"] + r["w"], F.lit(1.0)) - x, F.least(r["y"] + r["h"], F.lit(1.0)) - y)


def valid(r: Column) -> Column:
    return (r["w"] > 0) & (r["h"] > 0) & (r["x"] >= 0) & (r["y"] >= 0) & (r["x"] + r["w"] <= 1.0001) & (r["y"] + r["h"] <= 1.0001)


def lift(parent: Column, child: Column) -> Column:
    """A rectangle in its parent's shares, in the page's."""
    return rect(parent["x"] + child["x"] * parent["w"], parent["y"] + child["y"] * parent["h"], child["w"] * parent["w"], child["h"] * parent["h"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for rectangles that do not meet."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    common = w * h
    return F.when((w > 0) & (h > 0), common / (area(a) + area(b) - common)).otherwise(0.0)


def pad(r: Column, inches: float, page_w: Column, page_h: Column) -> Column:
    """Grown by ``inches`` on each side, on a page of so many inches; unchanged if the page has no size."""
    dx, dy = F.lit(inches) / page_w, F.lit(inches) / page_h
    grown = clamp(rect(r["x"] - dx, r["y"] - dy, r["w"] + 2 * dx, r["h"] + 2 * dy))
    return F.when((page_w > 0) & (page_h > 0), grown).otherwise(rect(r["x"], r["y"], r["w"], r["h"]))


def narrows(parent: Column, child: Column) -> Column:
    return (area(parent) > 0) & (area(child) / area(parent) < DESCENT)


def image_tokens(wide: Column, high: Column, most: int) -> Column:
    """Tokens of an image of so many pixels, one for each patch begun, ``most`` at most."""
    return F.least(F.ceil(wide / PATCH) * F.ceil(high / PATCH), F.lit(most))
