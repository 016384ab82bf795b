"""Folded texts with their way back, shingle hashes, alignment runs and blocks: the exact comparison of two texts, in numpy."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

WIDTH, MODULUS = 32, 32
LEAST_RUN = 40  # folded characters of a run that counts
SLACK = 600  # unmatched characters between two runs of one block
MOST_PLACES = 24  # places of a shingle in the compared text beyond which it anchors nothing
LEAST_GAP, MOST_GAPS, RAW_SPAN = 12, 8, 240

# The published FNV-1a and splitmix64 constants.
FNV_START, FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@lru_cache(maxsize=2)
def _tables(points: int = 0x110000) -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it kept, and its lower case (one code point to one)."""
    keep, low = np.zeros(points, bool), np.arange(points, dtype=np.uint32)
    for c in range(points):
        ch = chr(c)
        if ch.isalpha() or ch.isdecimal():
            keep[c] = True
            small = ch.lower()
            if len(small) == 1:
                low[c] = ord(small)
    return keep, low


@dataclass
class Folded:
    """Folded code points, the place of each in ``raw``, and page starts (folded offset, page) in order."""

    raw: str
    body: np.ndarray
    places: np.ndarray
    pages: list[tuple[int, int]] = field(default_factory=lambda: [(0, 1)])

    def page_at(self, at: int) -> int:
        page = self.pages[0][1]
        for off, number in self.pages:
            if off > at:
                break
            page = number
        return page

    def span(self, lo: int, hi: int) -> str:
        """The source text under folded characters lo to hi."""
        lo, hi = max(lo, 0), min(hi, len(self.places))
        if lo >= hi:
            return ""
        end = int(self.places[hi]) if hi < len(self.places) else len(self.raw)
        return self.raw[int(self.places[lo]) : end]


def fold(text: str, spans=None) -> Folded:
    """Letters and decimal digits, lower-cased; ``spans`` are (offset in the text, page)."""
    keep, low = _tables()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    places = np.flatnonzero(keep[points])
    pages = [(int(np.searchsorted(places, off)), page) for off, page in spans or [(0, 1)]]
    return Folded(text, low[points[places]], places, pages)


@lru_cache(maxsize=1)
def _bytes() -> tuple[bytes, bytes]:
    """The lower case of each byte of Latin-1, and the bytes that are not kept."""
    keep, low = _tables(256)
    return low.astype(np.uint8).tobytes(), np.flatnonzero(~keep).astype(np.uint8).tobytes()


def _latin(text: str) -> bytes | None:
    """The folded bytes of a text that Latin-1 can write, as most can."""
    try:
        return text.encode("latin-1").translate(*_bytes())
    except UnicodeEncodeError:
        return None


def body(text: str) -> np.ndarray:
    """The folded code points of ``fold`` alone."""
    found = _latin(text)
    return fold(text).body if found is None else np.frombuffer(found, np.uint8)


def lowered(text: str) -> bytes:
    """The letters and decimal digits of a text, lower-cased as a whole (one code point may become two): what tells equal texts, as in SQL."""
    found = _latin(text)
    if found is not None:
        return found.decode("latin-1").encode()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kept = points[_tables()[0][points]].tobytes()
    return kept.decode("utf-32-le", "surrogatepass").lower().encode("utf-8", "surrogatepass")


BLOCK = 1 << 15  # windows that are hashed together: more would leave a core's cache, few would take longer in calls than in sums


def _windows(body: np.ndarray, width: int):
    """(at, hashes): FNV-1a over each window of ``width`` code points, finished by splitmix64, BLOCK windows at a time."""
    for at in range(0, len(body) - width + 1, BLOCK):
        wide = body[at : at + BLOCK + width - 1].astype(np.uint64)
        h = np.full(len(wide) - width + 1, FNV_START)
        with np.errstate(over="ignore"):
            for k in range(width):
                h ^= wide[k : k + len(h)]
                h *= FNV_PRIME
            h ^= h >> np.uint64(30)
            h *= MIX_A
            h ^= h >> np.uint64(27)
            h *= MIX_B
            h ^= h >> np.uint64(31)
        yield at, h


def shingles(body: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The hashes of all windows of a text."""
    return np.concatenate([np.zeros(0, np.uint64), *(h for _, h in _windows(body, width))])


def sampled(bodies: list[np.ndarray], width: int = WIDTH, modulus: int = MODULUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the shingles that ``modulus`` divides, text by text, and where each text's begin and end among them.

    The texts are hashed as one, since a call takes longer than a short text's share; windows over an end are left out.
    """
    sizes = np.array([len(b) for b in bodies], np.int64)
    ends = np.cumsum(sizes)
    kept = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for first, h in _windows(np.concatenate(bodies), width):
        hit = np.flatnonzero(h % np.uint64(modulus) == 0)
        kept.append((hit + first, h[hit]))
    at, value = (np.concatenate(x) for x in zip(*kept))
    text = np.searchsorted(ends, at, "right")
    whole = at + width <= ends[text]
    at, value, text = at[whole], value[whole], text[whole]
    return at - (ends - sizes)[text], value.view(np.int64), np.append(0, np.cumsum(np.bincount(text, minlength=len(bodies))))


def kinds(hashes: np.ndarray) -> int:
    """How many distinct ones there are."""
    ordered = np.sort(hashes)
    return int(np.count_nonzero(ordered[1:] != ordered[:-1])) + bool(len(ordered))


def seeds(a: np.ndarray, b: np.ndarray, most: int = MOST_PLACES, ordered: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of equal shingles; those with more than ``most`` places in b anchor nothing.  ``ordered``: the order of b and b in it."""
    order, sorted_b = ordered or _ordered(b)
    low, high = np.searchsorted(sorted_b, a), np.searchsorted(sorted_b, a, "right")
    count = np.where(high - low > most, 0, high - low)
    i = np.repeat(np.arange(len(a)), count)
    inside = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
    return i, order[np.repeat(low, count) + inside]


def _ordered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes, kind="stable")
    return order, hashes[order]


def align(a: np.ndarray, b: np.ndarray, width: int = WIDTH, least: int = LEAST_RUN, most: int = MOST_PLACES) -> np.ndarray:
    """Runs (a from, a to, b from, b to) in order: seeds of one diagonal at most ``width`` apart are one run."""
    return _runs(*seeds(a, b, most), width, least)


def _runs(i: np.ndarray, j: np.ndarray, width: int, least: int) -> np.ndarray:
    if not len(i):
        return np.zeros((0, 4), np.int64)
    delta = j - i
    order = np.lexsort((i, delta))
    i, delta = i[order], delta[order]
    first = np.append(True, (np.diff(delta) != 0) | (np.diff(i) > width))
    starts = np.flatnonzero(first)
    last = np.append(starts[1:], len(i)) - 1
    lo, hi, d = i[starts], i[last] + width, delta[starts]
    runs = np.column_stack([lo, hi, lo + d, hi + d])[hi - lo >= least]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def masked(runs: np.ndarray, a_mask, b_mask, least: int = LEAST_RUN) -> np.ndarray:
    """Runs without what either side's mask covers; pieces under ``least`` go."""
    if not len(a_mask) and not len(b_mask):
        return runs
    out = []
    for lo, hi, b_lo, b_hi in runs.tolist():
        d = b_lo - lo
        cuts = sorted([(max(x, lo), min(y, hi)) for x, y in a_mask if x < hi and y > lo] + [(max(x, b_lo) - d, min(y, b_hi) - d) for x, y in b_mask if x < b_hi and y > b_lo])
        at = lo
        for x, y in [*cuts, (hi, hi)]:
            if x - at >= least:
                out.append((at, x, at + d, x + d))
            at = max(at, y)
    return np.array(out, np.int64).reshape(-1, 4)


def union_length(intervals) -> int:
    total, end = 0, None
    for lo, hi in sorted(intervals):
        lo = lo if end is None else max(lo, end)
        if hi > lo:
            total, end = total + hi - lo, hi
    return total


_COMMA, _NUMBER = re.compile(r"(?<=\d),(?=\d)"), re.compile(r"\d+(?:\.\d+)?")


def numbers(text: str) -> set[str]:
    """Numbers of two characters or more, without commas between digits."""
    return {t for t in _NUMBER.findall(_COMMA.sub("", text)) if len(t) > 1}


def _readable(text: str) -> str:
    text = " ".join(text.split())
    return text[:RAW_SPAN] + "…" if len(text) > RAW_SPAN else text


def chain(runs: np.ndarray, a: Folded, b: Folded, width: int = WIDTH) -> list[dict]:
    """Blocks of runs that go on in both texts, the one with most matched characters first.

    A run joins the open block that it fits best: not more than SLACK beyond the
    block's ends on either side, nor more than ``width`` before them.  Where both
    sides have text between, that is a gap.
    """
    done: list[dict] = []
    open_: list[dict] = []
    for lo, hi, b_lo, b_hi in runs.tolist():
        done += [x for x in open_ if x["a"][1] + SLACK < lo]
        open_ = [x for x in open_ if x["a"][1] + SLACK >= lo]
        fits = [(abs(lo - x["a"][1]) + abs(b_lo - x["b"][1]), k) for k, x in enumerate(open_) if -width <= lo - x["a"][1] <= SLACK and -width <= b_lo - x["b"][1] <= SLACK]
        if not fits:
            open_.append({"a": [lo, hi], "b": [b_lo, b_hi], "spans": [(lo, hi)], "gaps": []})
            continue
        block = open_[min(fits)[1]]
        a_end, b_end = block["a"][1], block["b"][1]
        if lo > a_end and b_lo > b_end:
            block["gaps"].append({"a_page": a.page_at(a_end), "b_page": b.page_at(b_end), "a_text": _readable(a.span(a_end, lo)), "b_text": _readable(b.span(b_end, b_lo))})
        block["a"][1], block["b"][1] = max(a_end, hi), max(b_end, b_hi)
        block["spans"].append((lo, hi))
    out = []
    for block in done + open_:
        (lo, hi), (b_lo, b_hi) = block["a"], block["b"]
        out.append(
            {
                "a_from": lo, "a_to": hi, "b_from": b_lo, "b_to": b_hi, "runs": len(block["spans"]), "matched_chars": union_length(block["spans"]), "span_chars": hi - lo,
                "a_from_page": a.page_at(lo), "a_to_page": a.page_at(hi - 1), "b_from_page": b.page_at(b_lo), "b_to_page": b.page_at(b_hi - 1), "gaps": worth_showing(block["gaps"]),
            }
        )
    return sorted(out, key=lambda x: -x["matched_chars"])


def worth_showing(gaps: list[dict]) -> list[dict]:
    """Gaps about numbers, and those with some length; the former first, then the longest; MOST_GAPS at most."""
    kept = []
    for g in gaps:
        numeric = numbers(g["a_text"]) != numbers(g["b_text"])
        if numeric or max(len(g["a_text"]), len(g["b_text"])) >= LEAST_GAP:
            kept.append((not numeric, -len(g["a_text"]) - len(g["b_text"]), g))
    return [g for _, _, g in sorted(kept, key=lambda x: x[:2])][:MOST_GAPS]


def relation(matched: int, a: float, b: float) -> str:
    if matched < 250 or max(a, b) < 0.55:
        return "overlap"
    return "duplicate" if min(a, b) >= 0.55 else "contained" if a >= 0.55 else "contains"


class Prepared:
    """A folded text with its shingles, in the order of the text and by value, for any number of comparisons."""

    def __init__(self, folded: Folded, mask=(), width: int = WIDTH):
        self.folded, self.mask, self.width = folded, [tuple(m) for m in mask], width
        self.hashes = shingles(folded.body, width)
        self.ordered = _ordered(self.hashes)
        value = self.ordered[1]
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
        self.distinct = value[first]
        self.crowded = bool(len(first)) and int(np.diff(np.append(first, len(value))).max()) > MOST_PLACES


def _measured(a: Prepared, b: Prepared, shared: int, runs: np.ndarray) -> dict:
    """All measures of a pair by its runs; matched characters and blocks are told on the side of ``a``."""
    runs = masked(runs, a.mask, b.mask)
    blocks = chain(runs, a.folded, b.folded, a.width)
    matched = union_length(map(tuple, runs[:, :2].tolist()))
    cover = lambda columns, n: min(union_length(map(tuple, runs[:, columns].tolist())), n) / n if n else 0.0
    a_cover, b_cover = cover([0, 1], len(a.folded.body)), cover([2, 3], len(b.folded.body))
    in_a = set().union(*(numbers(a.folded.span(k["a_from"], k["a_to"])) for k in blocks))
    in_b = set().union(*(numbers(b.folded.span(k["b_from"], k["b_to"])) for k in blocks))
    n_a, n_b = len(a.distinct), len(b.distinct)
    union = n_a + n_b - shared
    return {
        "relation": relation(matched, a_cover, b_cover), "jaccard": shared / union if union else 0.0, "a_in_b": shared / n_a if n_a else 0.0, "b_in_a": shared / n_b if n_b else 0.0,
        "a_cover": a_cover, "b_cover": b_cover, "shared": shared, "a_shingles": n_a, "b_shingles": n_b,
        "generic_chars": union_length(a.mask), "matched_chars": matched, "blocks": blocks, "only_in_a": sorted(in_a - in_b), "only_in_b": sorted(in_b - in_a),
    }


def compared(a: Prepared, b: Prepared, mirrored: bool = False) -> list[dict]:
    """The measures of a pair from the side of ``a``, and from that of ``b`` if ``mirrored``: seeds are found once for both.

    Only where a shingle has more than MOST_PLACES places in a text, do the two sides anchor on different ones.
    """
    shared = len(np.intersect1d(a.distinct, b.distinct, assume_unique=True))
    i, j = seeds(a.hashes, b.hashes, ordered=b.ordered)
    out = [_measured(a, b, shared, _runs(i, j, a.width, LEAST_RUN))]
    if mirrored:
        j, i = seeds(b.hashes, a.hashes, ordered=a.ordered) if a.crowded or b.crowded else (j, i)
        out.append(_measured(b, a, shared, _runs(j, i, a.width, LEAST_RUN)))
    return out


def compare(a: Folded, b: Folded, a_mask=(), b_mask=(), width: int = WIDTH) -> dict:
    """All measures of two folded texts, from the side of ``a``."""
    return compared(Prepared(a, a_mask, width), Prepared(b, b_mask, width))[0]
