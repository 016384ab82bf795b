"""Token ids by a public byte-level tokenizer, with an exact memo of pieces that is looked up for a whole column at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from textloom.llm.common import hash_spans, text_bytes, tokenizer_file

ENCODE_BYTES = 1 << 20  # text whose pieces are looked up at a time
LONGEST = 64  # bytes of a piece that the memo keeps
_MEMO_PIECES = 1_000_000
_SLOTS = 1 << 22
_JOINED = 1024

_BYTES = np.arange(256)
_SPACE = np.isin(_BYTES, [*range(0x09, 0x0E), *range(0x1C, 0x21)])
_LEAD = np.isin(_BYTES, [0xC2, 0xE1, 0xE2, 0xE3])  # first bytes of all other white space
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _white(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    out = _SPACE[raw]
    lead = np.flatnonzero(_LEAD[raw])
    if len(lead):
        padded = np.append(raw, np.zeros(2, np.uint8)).astype(np.uint32)
        two = padded[lead] << 8 | padded[lead + 1]
        three = two << 8 | padded[lead + 2]
        for mark in _WIDE:
            number = int.from_bytes(mark)
            for k in range(len(mark)):
                out[lead[(two if len(mark) == 2 else three) == number] + k] = True
    return out


def piece_starts(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the texts' pieces begin, and which bytes are white space: at a text's begin, and at single blanks and line ends between visible characters.

    The tokenizer's pre-tokens never span such a blank, which begins the next one,
    nor such a line end, which is one itself.
    """
    begins = np.zeros(len(raw) + 1, bool)
    begins[bounds] = True
    white = _white(raw)
    alone = np.zeros(len(raw), bool)
    if len(raw) > 2:
        alone[1:-1] = white[1:-1] & ~white[:-2] & ~white[2:] & ~begins[1:-2] & ~begins[2:-1]
    blank, line = alone & (raw == 0x20), np.flatnonzero(alone & (raw == 0x0A))
    starts = begins[:-1] | blank
    starts[line] = True
    starts[line + 1] = True
    return np.flatnonzero(starts), white


def _spread(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... length[i] numbers for each i, one after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - length), length)


@lru_cache(maxsize=2)
def encoder(file: str | None = None) -> "Encoder":
    """One encoder, with its memo, for all tasks of a Python worker."""
    return Encoder(file)


class Encoder:
    """``tokenizers`` ids of texts, as the library gives them with ``add_special_tokens=False``.

    Texts are cut into pieces (``piece_starts``) whose ids, put together, are those of
    the whole text.  Each piece is found in a hash table by a 64-bit hash, and its
    bytes are compared with the memo's, so an answer never rests on a hash.  New
    pieces are encoded many at a time, put together by blanks, and told apart by the
    byte lengths of their tokens.  Pieces over LONGEST bytes are encoded as they come.
    When the memo has ``_MEMO_PIECES``, it keeps those that
    were met again.
    """

    def __init__(self, file: str | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file or tokenizer_file())
        vocabulary = self.tokenizer.get_vocab()  # byte-level: a token has a character for each byte
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.bytes_of[number] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.slots = np.full(_SLOTS, -1, np.int32)
        self.count = 0
        self.keys, self.again = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, bool)
        self.facts = np.zeros((1 << 16, 4), np.int32)  # byte place, byte length, id place, id length
        self.text, self.ids = np.zeros(1 << 20, np.uint8), np.zeros(1 << 18, np.uint32)
        self.text_end = self.ids_end = 0

    def _trim(self) -> None:
        """Keep the pieces that were met again since they came in or since the last time."""
        used = np.flatnonzero(self.again[: self.count])
        used = used[: _MEMO_PIECES // 2]
        keys, facts, text, ids = self.keys[used], self.facts[used], self.text, self.ids
        self._clear()
        self._enter(keys, text[_spread(facts[:, 0], facts[:, 1])], facts[:, 1], ids[_spread(facts[:, 2], facts[:, 3])], facts[:, 3])

    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, raw: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and the number of each; every piece is a blank and visible characters."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        data, wanted = raw[_spread(starts, length)].tobytes(), np.cumsum(length)
        cuts = [0, *wanted[_JOINED - 1 : -1 : _JOINED].tolist(), len(data)]
        ids = np.concatenate(self._alone([data[a:b].decode() for a, b in zip(cuts, cuts[1:])]))
        reached = np.cumsum(self.bytes_of[ids])
        ends = np.searchsorted(reached, wanted)
        if not np.array_equal(reached[ends], wanted):
            raise ValueError("the tokenizer's tokens span a blank between words")
        return ids, np.diff(ends + 1, prepend=0)

    def _encoded(self, raw: np.ndarray, starts: np.ndarray, length: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in order, and the number of each; ``odd`` ones are not a blank and visible characters."""
        joined, alone = np.flatnonzero(~odd), np.flatnonzero(odd)
        ids, counts = self._together(raw, starts[joined], length[joined])
        if not len(alone):
            return ids, counts
        parts = self._alone([raw[a : a + n].tobytes().decode() for a, n in zip(starts[alone].tolist(), length[alone].tolist())])
        both = np.concatenate([counts, [len(p) for p in parts]]).astype(np.int64)
        place = np.append(0, np.cumsum(both))[:-1]
        back = np.empty(len(starts), np.int64)
        back[np.concatenate([joined, alone])] = np.arange(len(starts))
        return np.concatenate([ids, *parts])[_spread(place[back], both[back])], both[back]

    @staticmethod
    def _room(array: np.ndarray, end: int) -> np.ndarray:
        if end <= len(array):
            return array
        out = np.zeros((max(end, 2 * len(array)), *array.shape[1:]), array.dtype)
        out[: len(array)] = array
        return out

    def _learn(self, raw: np.ndarray, keys: np.ndarray, starts: np.ndarray, length: np.ndarray, odd: np.ndarray) -> None:
        ids, counts = self._encoded(raw, starts, length, odd)
        self._enter(keys, raw[_spread(starts, length)], length, ids, counts)

    def _enter(self, keys: np.ndarray, text: np.ndarray, length: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        first, n = self.count, len(keys)
        for name, end in (("keys", first + n), ("again", first + n), ("facts", first + n), ("text", self.text_end + len(text)), ("ids", self.ids_end + len(ids))):
            setattr(self, name, self._room(getattr(self, name), end))
        self.keys[first : first + n] = keys
        self.again[first : first + n] = False
        self.facts[first : first + n] = np.column_stack([self.text_end + np.cumsum(length) - length, length, self.ids_end + np.cumsum(counts) - counts, counts])
        self.text[self.text_end : self.text_end + len(text)] = text
        self.ids[self.ids_end : self.ids_end + len(ids)] = ids
        self.text_end, self.ids_end, self.count = self.text_end + len(text), self.ids_end + len(ids), first + n
        wait, slot = np.arange(first, first + n, dtype=np.int32), (keys & np.uint64(_SLOTS - 1)).astype(np.int64)
        while len(wait):  # each round, one of those that want a free slot gets it, the others go on
            free = self.slots[slot] < 0
            self.slots[slot[free]] = wait[free]
            there = self.slots[slot] == wait
            wait, slot = wait[~there], (slot[~there] + 1) & (_SLOTS - 1)

    def _found(self, keys: np.ndarray) -> np.ndarray:
        """The memo's number of each key, -1 where it has none."""
        slot = (keys & np.uint64(_SLOTS - 1)).astype(np.int64)
        out = self.slots[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & (_SLOTS - 1)
            out[open_] = self.slots[slot]
            more = (out[open_] >= 0) & (self.keys[out[open_]] != keys[open_])
            open_, slot = open_[more], slot[more]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column, one text after the other (null: none), and the n + 1 bounds of the texts."""
        raw, bounds = text_bytes(texts)
        starts, white = piece_starts(raw, bounds)
        length = np.diff(np.append(starts, len(raw)))
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        keys = hash_spans(raw, starts, starts + length, lower=False)
        long = length > LONGEST
        if self.count > _MEMO_PIECES:
            self._trim()
        at = self._found(keys)
        self.again[at[at >= 0]] = True
        new = np.flatnonzero((at < 0) & ~long)
        if len(new):
            fresh, first = np.unique(keys[new], return_index=True)
            first = new[first]
            odd = (raw[starts[first]] != 0x20) | (length[first] < 2) | (np.add.reduceat(white, starts, dtype=np.int32)[first] != 1)
            self._learn(raw, fresh, starts[first], length[first], odd)
            at[new] = self._found(keys[new])
        facts = self.facts[np.where(long, 0, at)]
        wrong = long | (facts[:, 1] != length)
        sure = np.flatnonzero(~wrong)
        same = self.text[_spread(facts[sure, 0], length[sure])] == (raw if len(sure) == len(wrong) else raw[np.repeat(~wrong, length)])
        if not same.all():  # another piece with the same hash
            wrong[np.repeat(sure, length[sure])[~same]] = True
        ids, place, count = self.ids, facts[:, 2].astype(np.int64), facts[:, 3].astype(np.int64)
        odd = np.flatnonzero(wrong)
        if len(odd):
            parts = self._alone([raw[a : a + n].tobytes().decode() for a, n in zip(starts[odd].tolist(), length[odd].tolist())])
            count[odd] = [len(p) for p in parts]
            place[odd] = self.ids_end + np.cumsum(count[odd]) - count[odd]
            ids = np.concatenate([ids[: self.ids_end], *parts])
        ends = np.append(0, np.cumsum(count))
        return ids[_spread(place, count)], ends[np.searchsorted(starts, bounds)]
