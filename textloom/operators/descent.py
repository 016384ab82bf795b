"""Pages read region by region: views that narrow where a model asks, renders that must earn their place, tiles where it cannot see."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import images
from textloom.functions.regions import _upper, reading_order

# Image tokens of a letter page on a square inch, the share of them under which a view is too coarse,
# pixels of a patch, the most tokens of an image, inches around a child, the area share from which a child is its parent.
LETTER_TOKENS, COARSE, PATCH, IMAGE_TOKENS, MARGIN, SAME_AREA = 39.0, 0.5, 28, 4000, 0.15, 0.8
SAME_BLOCK = 0.6  # overlap of two proposals that are one
LOOPED = 0.5  # share of repeated lines from which a reading is a loop
ALIEN = 0.05  # share of what was expected under which a reading is of something else

REGION = (
    "region string, parent string, depth int, x double, y double, w double, h double, rotation int, filter string, kind string, text string, "
    "flags array<string>, dpi int, sha256 string, tokens_per_sq_in double"
)


@dataclass(frozen=True)
class Limits:
    """How far a page is followed."""

    depth: int = 1
    calls: int = 40
    children: int = 8
    transforms: int = 2
    inches: float = 1.0  # sides under which a closer view shows nothing more
    tile: bool = False


def lines_of(text: str) -> list[str]:
    """Lines in upper case with single blanks, of more than three bytes."""
    found = (_upper(" ".join(line.split())) for line in text.split("\n"))
    return [line for line in found if len(line.encode()) > 3]


def looping(text: str) -> bool:
    lines = lines_of(text)
    return bool(lines) and 1 - len(set(lines)) / len(lines) >= LOOPED


def distinct_bytes(text: str) -> int:
    return sum(len(line.encode()) for line in set(lines_of(text)))


def share_of_expected(text: str, expected: str, width: int = 5) -> float:
    windows = lambda t: [t[i : i + width] for i in range(len(t) - width + 1)]
    wanted, there = windows(_upper(expected)), set(windows(_upper(text)))
    return sum(w in there for w in wanted) / len(wanted) if wanted else 0.0


def earned(before: dict, after: dict, expected: str) -> bool:
    """Whether a new render of a region reads better.

    A loop never wins against none, nor loses to one.  Then counts a flag that went;
    then which reading has more of what the parent said is there; then which one has
    more text, each line once.
    """
    loops = looping(before["text"]), looping(after["text"])
    if loops[0] != loops[1]:
        return loops[0]
    if set(before["flags"]) - set(after["flags"]) - {"exhausted", "budget"}:
        return True
    if expected.strip():
        shares = [share_of_expected(r["text"], expected) for r in (before, after)]
        if shares[0] != shares[1]:
            return shares[1] > shares[0]
    return distinct_bytes(after["text"]) > distinct_bytes(before["text"])


Box = tuple[float, float, float, float]


def on_page(box: Box) -> Box:
    """The part of a box that is on the page."""
    x, y, w, h = box
    left, top = max(x, 0.0), max(y, 0.0)
    return left, top, min(x + w, 1.0) - left, min(y + h, 1.0) - top


def within(parent: Box, child: Box) -> Box:
    return parent[0] + child[0] * parent[2], parent[1] + child[1] * parent[3], child[2] * parent[2], child[3] * parent[3]


def overlap(a: Box, b: Box) -> float:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h) if w > 0 and h > 0 else 0.0


def rendered(page: np.ndarray, box: Box, rotation: int, filter_: str) -> np.ndarray:
    """The pixels of a region: cut out, turned, then repaired."""
    view = images.rotated(images.cropped(page, *box), rotation)
    return {"contrast": images.equalised, "sharpen": images.sharpened}.get(filter_, lambda v: v)(view)


def digest(view: np.ndarray) -> str:
    """What identifies a render: its sides and bytes."""
    return hashlib.sha256(f"{view.shape[0]}x{view.shape[1]}:".encode() + np.ascontiguousarray(view).tobytes()).hexdigest()


class Reader:
    """One page's reading.  ``ask(view, depth, damage)`` tells text, kind, repeated, and regions: boxes in shares of the view, with rotation, filter and kind."""

    def __init__(self, page: np.ndarray, ask: Callable, wide: float, high: float, dpi: int, limits: Limits):
        self.page, self.ask, self.wide, self.high, self.dpi, self.limits = page, ask, wide, high, dpi, limits
        self.calls, self.seen = 0, set()

    def read(self, number: int) -> list[dict]:
        """All regions, each parent before its children, which are in reading order."""
        root = self._region((0.0, 0.0, 1.0, 1.0))
        self._visit(root, 0, "")
        out = []

        def listed(node: dict, name: str, parent: str | None) -> None:
            children = node.pop("children")
            x, y, w, h = node.pop("box")
            out.append({"region": name, "parent": parent, **node, "x": x, "y": y, "w": w, "h": h})
            for i, k in enumerate(reading_order([c["box"][:2] for c in children])):
                listed(children[k], f"{name}.{i}", name)

        listed(root, f"p{number}", None)
        return out

    def _region(self, box: Box, rotation: int = 0, filter_: str = "", kind: str = "", depth: int = 0) -> dict:
        return {"box": box, "rotation": rotation, "filter": filter_, "kind": kind, "depth": depth, "text": "", "flags": [], "dpi": self.dpi, "sha256": "", "tokens_per_sq_in": 0.0, "children": []}

    def _detail(self, box: Box) -> float:
        """Image tokens that a square inch of a region gets."""
        inches = box[2] * self.wide, box[3] * self.high
        patches = math.prod(math.ceil(int(i * self.dpi) / PATCH) for i in inches)
        return min(patches, IMAGE_TOKENS) / math.prod(inches) if math.prod(inches) > 0 else 0.0

    def _padded(self, box: Box) -> Box:
        if self.wide <= 0 or self.high <= 0:
            return box
        dx, dy = MARGIN / self.wide, MARGIN / self.high
        return on_page((box[0] - dx, box[1] - dy, box[2] + 2 * dx, box[3] + 2 * dy))

    def _visit(self, region: dict, tries: int, expected: str) -> None:
        flag = lambda name: name in region["flags"] or region["flags"].append(name)
        region["tokens_per_sq_in"] = self._detail(region["box"])
        if region["tokens_per_sq_in"] < LETTER_TOKENS * COARSE:
            flag("low-resolution")
        view = rendered(self.page, region["box"], region["rotation"], region["filter"])
        damage = images.faults(view)
        for name in damage:
            flag(name)
        region["sha256"] = digest(view)
        if region["sha256"] in self.seen:
            return flag("cycled")
        if self.calls >= self.limits.calls:
            return flag("budget")
        self.seen.add(region["sha256"])
        self.calls += 1
        told = self.ask(view, region["depth"], damage)
        region["text"], region["kind"] = told.get("text") or "", region["kind"] or told.get("kind") or ""
        if told.get("repeated"):
            flag("repetition")
        if expected.strip() and region["text"].strip() and share_of_expected(region["text"], expected) < ALIEN:
            flag("transform-suspect")
        if region["depth"] >= self.limits.depth:
            return flag("budget")
        closer, again = self.routed(region, told.get("regions") or [])
        if self.limits.tile and region["kind"] == "drawing" and "low-resolution" in region["flags"]:
            tiles = self.tiles(region)
            # tiles are a partition: none is left out, and others only where there is room
            closer = (tiles + closer)[: max(len(tiles), self.limits.children)] if tiles else closer
        if not closer and not again:
            return flag("exhausted")
        said = region["text"]
        for rotation, filter_ in again:
            other = self._region(region["box"], rotation, filter_, region["kind"], region["depth"])
            if tries < self.limits.transforms:
                self._visit(other, tries + 1, expected)
            if tries >= self.limits.transforms or "cycled" in other["flags"] or not earned(region, other, expected):
                flag("cycled")
                break
            region["children"] += other["children"]
            region |= {k: other[k] for k in ("text", "flags", "rotation", "filter", "sha256")}
        for box, rotation, kind in closer:
            if self.calls >= self.limits.calls:
                flag("budget")
                break
            child = self._region(box, rotation, "", kind, region["depth"] + 1)
            self._visit(child, 0, said)
            region["children"].append(child)

    def routed(self, region: dict, proposals: list[dict]) -> tuple[list[tuple], list[tuple]]:
        """Proposals by their geometry: closer views (box, rotation, kind), and new renders (rotation, filter) of the same area."""
        closer, again = [], []
        for p in proposals:
            box = on_page(tuple(float(p.get(k) or 0.0) for k in "xywh"))
            if box[2] <= 0 or box[3] <= 0:
                continue
            place = within(region["box"], box)
            if place[2] * self.wide < self.limits.inches and place[3] * self.high < self.limits.inches:
                continue
            rotation, filter_ = int(p.get("rotation") or 0), p.get("filter") or ""
            if box[2] * box[3] < SAME_AREA:
                padded = self._padded(place)
                if all(overlap(c[0], padded) < SAME_BLOCK for c in closer):
                    closer.append((padded, rotation, p.get("kind") or ""))
                continue
            filter_ = filter_ if filter_ in ("contrast", "sharpen") else ""
            if (rotation, filter_) != (region["rotation"], region["filter"]):
                again.append((rotation, filter_))
        return closer[: self.limits.children], again

    def tiles(self, region: dict) -> list[tuple]:
        """A coarse region cut into as many parts as it takes to see them, 2 to 6 a side; none where they would be too small."""
        wanted = LETTER_TOKENS / region["tokens_per_sq_in"] if region["tokens_per_sq_in"] > 0 else 0
        x, y, w, h = region["box"]
        n = min(max(math.ceil(math.sqrt(wanted)), 2), 6)
        if wanted <= 1 or min(w * self.wide, h * self.high) / n < self.limits.inches:
            return []
        return [(self._padded((x + c * w / n, y + r * h / n, w / n, h / n)), region["rotation"], "drawing") for r in range(n) for c in range(n)]


# ---------------------------------------------------------------- tables of pages

PAGE = ["path", "page", "image", "wide", "high", "wide_in", "high_in", "dpi"]


def _grey(r) -> np.ndarray:
    return np.frombuffer(bytes(r.image), np.uint8).reshape(r.high, r.wide)


def read_regions(pages: DataFrame, ask: Callable, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """(path, page, REGION): the region trees of pages.

    ``pages`` has path, page, image (grey bytes, row by row), wide and high (pixels),
    wide_in and high_in (inches) and dpi.  A page is read in one task, with
    ``limits.calls`` calls at most; pages without an image have no rows.
    """
    names = ["path", "page", *(f.split()[0] for f in REGION.split(", "))]

    def run(batches):
        for batch in batches:
            rows = [{"path": r.path, "page": r.page, **found} for r in batch.itertuples(index=False) for found in Reader(_grey(r), ask, r.wide_in, r.high_in, int(r.dpi), limits).read(int(r.page))]
            yield pd.DataFrame(rows, columns=names)

    return pages.where("image is not null").select(*PAGE).mapInPandas(run, f"path string, page int, {REGION}")


def verified(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """(path, page, region, holds): whether a region, rendered again from its page, has the digest of what it was read from.

    A region whose page is not there does not hold.  A page's image is sent once for all its regions.
    """
    spots = regions.groupBy("path", "page").agg(F.collect_list(F.struct("region", "x", "y", "w", "h", "rotation", "filter", "sha256")).alias("spots"))
    met = spots.join(pages.select(*PAGE), ["path", "page"], "left").select(*PAGE, "spots")

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                page = _grey(r) if r.image is not None else None
                for s in r.spots:
                    again = page is not None and digest(rendered(page, (s["x"], s["y"], s["w"], s["h"]), s["rotation"], s["filter"])) == s["sha256"]
                    rows.append((r.path, r.page, s["region"], again))
            yield pd.DataFrame(rows, columns=["path", "page", "region", "holds"])

    return met.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("wide", "high")}).mapInPandas(run, "path string, page int, region string, holds boolean")
