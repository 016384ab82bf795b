"""Sequential text cutting: boundary cuts, token budgets, and the assembly of fragments across pages."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

LEAST_TAKE = 500  # characters that a cut takes at least
MIN_CHARS, MAX_CHARS = 3000, 9000
HEADROOM = 0.66
_MARKS = ("\n\n", ". ", ".\n", "\n", " ")


def boundary(text: str, limit: int) -> int:
    """Where to cut ``text`` at ``limit`` or before: after the last paragraph, sentence, line or word end of its last third."""
    if limit >= len(text):
        return len(text)
    low = limit * 2 // 3
    for mark in _MARKS:
        found = text.rfind(mark, low, limit)
        if found >= 0:
            return found + len(mark)
    return limit


def split_at_boundary(text: str, limit: int) -> list[str]:
    out = []
    while len(text) > limit:
        at = boundary(text, limit)
        out.append(text[:at].strip())
        text = text[at:]
    return out + ([text.strip()] if text.strip() else [])


@dataclass(frozen=True)
class Budget:
    """A limit of tokens (0: none), counted by ``count``; ``reserve`` of them are kept free."""

    limit: int
    count: Callable[[str], int] = lambda text: len(text.encode()) // 2 + 16
    reserve: int = 0
    ratio: float = 2.0  # characters a token, the first guess

    def fits(self, text: str) -> bool:
        return self.limit <= 0 or self.count(text) <= self.limit - self.reserve

    def _shrunk(self, room: int, n: int, part: Callable[[int], str], least: int) -> int:
        """A guess at the characters that ``room`` tokens hold, corrected four times at most."""
        take = int(room * self.ratio)
        for _ in range(4):
            take = max(min(take, n), min(least, n))
            tokens = self.count(part(take))
            if tokens <= room or take <= least:
                return take
            take = int(take * room / tokens * 0.95)
        return max(take, min(least, n))

    def fit(self, rest: str, overhead: str = "", least: int = LEAST_TAKE) -> int:
        """How many characters of ``rest`` go beside ``overhead``; ``least`` at least, so that there is progress."""
        if self.limit <= 0 or not rest:
            return len(rest)
        room = self.limit - self.reserve - (self.count(overhead) if overhead else 0)
        if room <= 0:
            return min(least, len(rest))
        return len(rest) if self.count(rest) <= room else self._shrunk(room, len(rest), lambda k: rest[:k], least)

    def fit_suffix(self, text: str, room: int) -> int:
        """How many of the last characters of ``text`` go into ``room`` tokens."""
        if room <= 0 or not text:
            return 0
        return len(text) if self.count(text) <= room else self._shrunk(room, len(text), lambda k: text[len(text) - k :] if k else "", 0)


def spans_of_slice(spans: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
    """Page spans (offset, page) of text[low:high], from 0; none where it lies on one page."""
    inside = [(off - low, page) for off, page in spans if low < off < high]
    if not inside:
        return []
    return [(0, [page for off, page in spans if off <= low][-1:][0] if spans[0][0] <= low else spans[0][1]), *inside]


def split_to_budget(text: str, budget: Budget, spans: list[tuple[int, int]] = (), start: int | None = None) -> list[dict]:
    """``text`` in pieces that fit, cut at boundaries, with their own page spans and, from ``start``, offsets; no character is lost."""
    pieces, at = [], 0
    while at < len(text) or not pieces:
        rest = text[at:]
        take = len(rest) if budget.fits(rest) else budget.fit(rest)
        if take < len(rest):
            cut = boundary(rest, take)
            take = cut if cut >= LEAST_TAKE else take
        piece = {"text": rest[:take], "spans": spans_of_slice(list(spans), at, at + take) if spans else []}
        if start is not None:
            piece |= {"start_off": start + at, "end_off": start + at + take}
        pieces.append(piece)
        at += max(take, 1)
    return pieces


def oversized(texts: list[str], budget: Budget) -> dict[int, float]:
    """How many times too long each text is that does not fit."""
    room = budget.limit - budget.reserve
    return {i: budget.count(t) / room for i, t in enumerate(texts) if not budget.fits(t)}


def complaint(over: dict[int, float]) -> str:
    """What to ask for where fragments are too long."""
    return "; ".join(f"fragment {i + 1} is {ratio * 100:.0f}% of the maximum length: split it into at least {math.ceil(ratio / HEADROOM) + 1}" for i, ratio in sorted(over.items()))


def open_context(text: str, budget: Budget, fixed: str, least_tokens: int = 1000) -> str:
    """The tail of an open fragment that leaves room for a page beside it."""
    if budget.limit <= 0 or not text or budget.count(fixed + text) + least_tokens <= budget.limit:
        return text
    keep = budget.fit_suffix(text, budget.limit - budget.count(fixed) - least_tokens)
    return text[len(text) - keep :] if keep else ""


def assembled(pages: Iterable[tuple[int, list[str], bool]], least: int = MIN_CHARS, most: int = MAX_CHARS) -> list[dict]:
    """Fragments (page, ord, text, spans) from each page's segments and whether its first one continues the page before.

    The open fragment takes in what continues it, and any segment while it is under
    ``least`` and stays within ``most``; else it is closed.  ``spans`` tells where
    pages begin in a fragment of several.
    """
    out: list[dict] = []
    now: dict | None = None
    ords: dict[int, int] = {}
    for page, segments, continues in pages:
        for i, text in enumerate(segments):
            text = text.strip()
            if not text:
                continue
            joins = now is not None and ((i == 0 and continues) or (0 < len(now["text"]) < least and len(now["text"]) + len(text) <= most))
            if joins:
                now["text"] += "\n\n"
                if now["spans"][-1][1] != page:
                    now["spans"].append((len(now["text"]), page))
                now["text"] += text
                continue
            if now is not None:
                out.append(now)
            now = {"page": page, "ord": ords.get(page, 0), "text": text, "spans": [(0, page)]}
            ords[page] = now["ord"] + 1
    if now is not None:
        out.append(now)
    return [f if len(f["spans"]) > 1 else {**f, "spans": []} for f in out]
