"""Runs of repeated words: Crochemore's refinement of classes of equal factors, by the smaller halves."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import WORD, chunks, giving_back, hash_spans, mix64, split_table, text_bytes, word_spans
from textloom.llm.encode import _spread

LEAST = 12  # words of the shortest run
WIDE = 8  # factor lengths that are refined for a whole chunk of texts at once; longer ones by smaller halves

RUN = "struct<start:long,length:long,period:long>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"


# ---------------------------------------------------------------- refinement


def _classed(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (ascending) whose key occurs again, by class and place, and the number of each one's class."""
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    if not len(keys):
        return at, np.zeros(0, np.int64)
    new = np.append(True, keys[1:] != keys[:-1])
    more = ~(new & np.append(new[1:], True))
    return at[more], np.cumsum(new[more]) - 1


def _squares(at: np.ndarray, names: np.ndarray, level: int) -> np.ndarray:
    """Where a factor of ``level`` words is followed by itself, and no third one begins between: its root has no shorter period."""
    here = np.flatnonzero((names[1:] == names[:-1]) & (at[1:] - at[:-1] == level))
    return at[here]


def _wide(keys: np.ndarray, at: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Squares by root length up to WIDE, of all texts at once, then places and classes of what may have longer ones.

    ``at``: ascending places of the words, with one free place between texts.
    """
    squares, names = [], np.zeros(0, np.int64)
    name_at = np.full(size + 1, -1, np.int64)
    for level in range(1, WIDE + 1):
        if level > 1:
            order = np.argsort(at)
            at, names = at[order], names[order]
            live = name_at[at + 1] >= 0
            following = name_at[at + 1][live]
            name_at[at] = -1
            at, keys = at[live], names[live] * np.int64(size + 1) + following
        at, names = _classed(keys, at)
        name_at[at] = names
        squares.append(_squares(at, names, level))
    if len(at):  # members that stand within WIDE places of each other have no longer square before them
        first = np.append(True, names[1:] != names[:-1])
        group = np.flatnonzero(first)
        reach = at[np.append(group[1:], len(at)) - 1] - at[group]
        far = np.repeat(reach > WIDE, np.diff(np.append(group, len(at))))
        at, names = at[far], names[far]
        order = np.argsort(at)
        at, names = at[order], names[order]
    return squares, at, names


class _Narrow:
    """Classes of one text's places whose factors of ``level`` words are equal, refined word by word.

    A class is a linked list in order of place, so that a member leaves in constant
    time and only gaps beside it change.  Going to the next length, a class is split by
    the classes of the following places; of the parts into which a class fell the last
    time the largest is left out, so a place is handled only as one of a smaller half.
    Members of a class that does not reach as far as its length have no square of it or a longer one
    before them, nor have the places before them, and are dropped like single ones.
    """

    def __init__(self, places: list[int], names: list[int], level: int):
        self.level, self.name = level, dict(zip(places, names))
        self.before, self.after, self.size, self.head = {}, {}, {}, {}
        self.gaps: dict[int, list[int]] = defaultdict(list)
        members: dict[int, list[int]] = defaultdict(list)
        for place, name in zip(places, names):
            members[name].append(place)
        for name, part in members.items():
            self._link(name, part)
        self.next_name = max(members, default=-1) + 1
        # at first every class is a splitter, and so is every dropped place behind a member
        self.splitters = [*members.values(), *([p + 1] for p in places if p + 1 not in self.name)]

    def _link(self, name: int, part: list[int]) -> None:
        self.size[name], self.head[name] = len(part), part[0]
        for a, b in zip(part, part[1:]):
            self.after[a], self.before[b] = b, a
            self.gaps[b - a].append(a)

    def _leave(self, name: int, place: int) -> None:
        before, after = self.before.pop(place, None), self.after.pop(place, None)
        if before is None:
            self.head[name] = after
        elif after is None:
            del self.after[before]
        else:
            self.after[before] = after
            self.gaps[after - before].append(before)
        if after is not None:
            if before is None:
                del self.before[after]
            else:
                self.before[after] = before

    def _members(self, name: int) -> list[int]:
        out, place = [], self.head[name]
        while place is not None:
            out.append(place)
            place = self.after.get(place)
        return out

    def refine(self) -> list[int]:
        """Go on to the next length; where squares of that root length begin."""
        self.level += 1
        found: dict[int, list[list[int]]] = {}
        for splitter in self.splitters:
            parts: dict[int, list[int]] = {}
            for place in splitter:
                name = self.name.get(place - 1)
                if name is not None:
                    parts.setdefault(name, []).append(place - 1)
            for name, part in parts.items():
                found.setdefault(name, []).append(part)
        self.splitters = []
        for name, parts in found.items():
            rest = self.size[name] - sum(map(len, parts))
            largest = max(parts, key=len)
            if not rest:
                parts.remove(largest)  # it keeps the class's name
                if not parts:
                    continue
                rest = len(largest)
            for part in parts:
                for place in part:
                    self._leave(name, place)
                if part[-1] - part[0] >= self.level:
                    self._link(self.next_name, part)
                    for place in part:
                        self.name[place] = self.next_name
                    self.next_name += 1
                else:
                    for place in part:
                        del self.name[place]
            self.size[name] = rest
            if rest < len(largest) and largest in parts:
                parts.remove(largest)
                parts.append(self._members(name))
            self.splitters.extend(parts)
            if rest == 1:
                del self.name[self.head[name]]
        return sorted({i for i in self.gaps.pop(self.level, ()) if self.after.get(i) == i + self.level and i in self.name})


def _runs(keys: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of ``least`` words and more as (text, start, length, period), by text, start and period; ``keys`` name the words."""
    n = np.diff(bounds)
    own = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(own)) + own
    with np.errstate(over="ignore"):
        tagged = mix64(keys ^ mix64(own.astype(np.uint64) + np.uint64(1)))
    squares, rest, names = _wide(tagged, at, len(own) + len(n))
    periods = [np.full(len(s), level, np.int64) for level, s in enumerate(squares, 1)]
    first = bounds[:-1] + np.arange(len(n))  # each text's first place
    text = np.searchsorted(first, rest, side="right") - 1
    for k in np.unique(text).tolist():
        a, b = np.searchsorted(text, [k, k + 1])
        narrow = _Narrow(rest[a:b].tolist(), names[a:b].tolist(), WIDE)
        while narrow.level < n[k] // 2 and narrow.name:
            if here := narrow.refine():
                squares.append(np.array(here, np.int64))
                periods.append(np.full(len(here), narrow.level, np.int64))
    at, period = np.concatenate(squares), np.concatenate(periods)
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    new = np.append(True, (at[1:] != at[:-1] + 1) | (period[1:] != period[:-1])) if len(at) else np.zeros(0, bool)
    begin = np.flatnonzero(new)  # squares side by side make a run
    start, period, length = at[begin], period[begin], np.diff(np.append(begin, len(at))) - 1 + 2 * period[begin]
    text = np.searchsorted(first, start, side="right") - 1
    keep = np.flatnonzero(length >= least)
    keep = keep[np.lexsort((period[keep], start[keep]))]
    return text[keep], (start - first[text])[keep] if len(text) else start, length[keep], period[keep]


def _joined(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, own: np.ndarray, n: int) -> pa.Array:
    """The given words of each text with one space between, as strings."""
    width = stops - starts + 1
    last = np.append(own[1:] != own[:-1], True) if len(own) else np.zeros(0, bool)
    out = np.append(raw, np.uint8(0x20))[_spread(starts, width)]
    ends = np.cumsum(width)
    out[ends - 1] = 0x20
    out = np.delete(out, ends[last] - 1)
    size = np.bincount(own, width, n).astype(np.int64)
    size[own[last]] -= 1
    offsets = np.append(0, np.cumsum(size))
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out.tobytes())])


def repeated_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Each text's maximal runs of words, and the text without their repeats.

    A run is a stretch of words with smallest period q, of at least ``least`` and 2q
    words, that no neighbouring word extends.  ``collapsed`` is the text's words, one
    space between, without those that stand in a run after its first q words.

    One row for each row of ``docs`` (doc_id, text), which need not be distinct and may
    have a null id; other columns are ignored.  Null and empty texts, and those of white
    space, have no words, no runs and an empty ``collapsed``.  Texts are refined whole:
    a longer one takes memory by its length, and time by its length times its logarithm.
    """

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                raw, bounds = text_bytes(part.column("text"))
                starts, stops, at = word_spans(raw, bounds)
                own = np.repeat(np.arange(len(at) - 1), np.diff(at))
                text, start, length, period = _runs(hash_spans(raw, starts, stops, lower=False), at, least)
                open_ = np.zeros(len(own) + 1, np.int64)
                np.add.at(open_, at[text] + start + period, 1)
                np.add.at(open_, at[text] + start + length, -1)
                kept = np.cumsum(open_)[:-1] == 0
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"])
                listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(at))), pa.int32()), runs)
                collapsed = _joined(raw, starts[kept], stops[kept], own[kept], len(at) - 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at), pa.int64()), listed, collapsed.cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return split_table(slim, docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(giving_back(run), SCHEMA)


def looped(docs: DataFrame) -> DataFrame:
    """``docs`` in which about a tenth of the texts go round: from word a on, the p words there come again and again.

    With h the CRC-32 of the id's decimal text and g = h / 10, these are the ids with
    h % 10 = 0, a = g % n and p = 1 + (n - a) / (3 + g % 8).  Rows without an id or
    without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.expr(f"regexp_extract_all(text, '{WORD.replace(chr(92), chr(92) * 2)}', 0)")
    going = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    going = going.withColumn("n", F.size("words").cast("long")).withColumn("g", F.expr("h div 10"))
    going = going.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    turned = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[cast(a + (i - a) % p as int)])), ' ')")
    return going.select("doc_id", F.when(F.col("n") > 0, turned).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """One row a text: its number of runs, the longest one (ties: the first, then the shorter period), digests of all and of the collapsed text."""
    longest = F.expr("aggregate(runs, cast(null as struct<start:long,length:long,period:long>), (s, r) -> if(s is null or r.length > s.length, r, s))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    rows = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
