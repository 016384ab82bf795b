"""Alignment of two tokenizers over one corpus: links of tokens that end together, counted in dense stripes of ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import chunks, giving_back, materialize, slices, split_table, text_bytes, tokenizer_file
from textloom.llm.encode import ENCODE_BYTES, Encoder, _spread

BLOCK_BYTES = 2 << 20  # text whose links travel together
CELLS = 1 << 23  # of a stripe's dense matrix
ROW_LINKS = 1 << 14  # links, or pairs, of a row at most
PART_LINKS = 1 << 22  # links of a stripe that one task scores
PENDING_PAIRS = 1 << 21  # different pairs that a task counts before it passes them on

#: Fixed value: the sign that a piece has for a space.
SPACE_SIGN = "▁"


# ---------------------------------------------------------------- tokenizers


class PlainEncoder(Encoder):
    """Ids of a byte-level vocabulary, where the strings of special tokens are plain text; ``spelled`` has the bytes of each id."""

    def __init__(self, file: str | None = None):
        super().__init__(file)
        self.tokenizer.encode_special_tokens = True
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(visible)))}
        tokens = {number: token for token, number in self.tokenizer.get_vocab().items()}
        self.spelled = Spelling(bytes(letters[c] for c in tokens.get(i, "") if c in letters) for i in range(max(tokens) + 1))


class PieceEncoder(Encoder):
    """Ids of a sentencepiece vocabulary for texts that begin with the blank that the library puts before a text.

    Only a vocabulary whose pieces have blanks at their begin alone and no line end can
    be looked up piece by piece; another one is refused.  Texts must not hold SPACE_SIGN.
    """

    def __init__(self, file: str | None = None):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=file or tokenizer_file("piece_bpe_32k.model"))
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(SPACE_SIGN in p.lstrip(SPACE_SIGN) or "\n" in p for p in pieces):
            raise ValueError("a piece of this vocabulary spans a blank between words or a line end")
        single = lambda i, p: bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE_SIGN, " ").encode()
        self.spelled = Spelling(single(i, p) for i, p in enumerate(pieces))
        self.bytes_of = np.diff(self.spelled.bounds)
        self.line = self.model.encode("\n")  # a blank, then the line end
        self._clear()

    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        after_line = [not t.startswith(" ") for t in texts]
        found = self.model.encode(["\n" + t if bare else t[1:] for t, bare in zip(texts, after_line)], num_threads=1)
        blank = self.line[:1]
        return [np.array(ids[len(self.line) :] if bare else ids or blank, np.uint32) for ids, bare in zip(found, after_line)]


class Spelling:
    """The bytes of all ids, one after the other."""

    def __init__(self, tokens):
        tokens = list(tokens)
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)
        self.bounds = np.append(0, np.cumsum([len(t) for t in tokens])).astype(np.int64)

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        return self.bounds[ids + 1] - self.bounds[ids]

    def of(self, ids: np.ndarray) -> np.ndarray:
        ids = ids.astype(np.int64)
        return self.raw[_spread(self.bounds[ids], self.lengths(ids))]


@lru_cache(maxsize=2)
def encoders(file_a: str | None, file_b: str | None) -> tuple[PlainEncoder, PieceEncoder]:
    """One pair of encoders, with their memos, for all tasks of a Python worker."""
    return PlainEncoder(file_a), PieceEncoder(file_b)


def _ids(encoder: Encoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts, bounds, batch = [], [np.zeros(1, np.int64)], pa.RecordBatch.from_arrays([texts], names=["text"])
    for part in chunks(batch, "text", ENCODE_BYTES):
        ids, at = encoder.encode(part.column(0))
        parts.append(ids.astype(np.int64))
        bounds.append(at[1:] + bounds[-1][-1])
    return np.concatenate([np.zeros(0, np.int64), *parts]), np.concatenate(bounds)


def encoded(texts: pa.Array, a: Encoder, b: Encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both sides' ids and bounds; a text that either side does not spell exactly, byte for byte, has none on both."""
    texts = texts.cast(pa.large_string())
    live = pc.and_(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False), pc.invert(pc.fill_null(pc.match_substring(texts, SPACE_SIGN), False)))
    while True:
        shown = pc.if_else(live, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())), pa.scalar(None, pa.large_string()))
        raw, bounds = text_bytes(shown)
        sides, wrong = [], np.zeros(len(texts), bool)
        for encoder in (a, b):
            ids, at = _ids(encoder, shown)
            ends = np.append(0, np.cumsum(encoder.spelled.lengths(ids)))[at]
            if not np.array_equal(ends, bounds):
                wrong |= np.diff(ends) != np.diff(bounds)
            elif len(odd := np.flatnonzero(encoder.spelled.of(ids) != raw)):
                wrong[np.searchsorted(bounds, odd, side="right") - 1] = True
            sides += [ids, at]
        if not wrong.any():
            return tuple(sides)
        live = pc.and_(live, pa.array(~wrong))


# ---------------------------------------------------------------- links and groups


def linked(a: np.ndarray, length_a: np.ndarray, b: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of either side end where one of the other side does; tokens have a byte at least."""
    end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
    size = int(end_a[-1]) + 1 if len(end_a) else 1
    at_a, at_b = np.zeros(size, bool), np.zeros(size, bool)
    at_a[end_a] = at_b[end_b] = True
    return at_b[end_a], at_a[end_b]


@lru_cache(maxsize=4)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All decimal numbers below ``n``, each with a comma behind it, and their bounds."""
    words = [f"{i}," for i in range(n)]
    return np.frombuffer("".join(words).encode(), np.uint8), np.append(0, np.cumsum([len(w) for w in words])).astype(np.int64)


def group_texts(a: np.ndarray, cut_a: np.ndarray, b: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``a1,a2|b1;`` for all groups, and each group's end in them."""
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    ends_a, ends_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1
    merged = np.empty(len(a) + len(b), np.int64)
    sign = np.full(len(merged), ord(","), np.uint8)
    place_a = np.arange(len(a)) + np.append(0, ends_b)[group_a]
    place_b = np.arange(len(b)) + ends_a[group_b]
    merged[place_a], merged[place_b] = a, b
    sign[place_a[cut_a]], sign[place_b[cut_b]] = ord("|"), ord(";")
    raw, bounds = _decimals(int(merged.max(initial=0)) + 1)
    width = bounds[merged + 1] - bounds[merged]
    out = raw[_spread(bounds[merged], width)]
    ends = np.cumsum(width)
    out[ends - 1] = sign
    return out, ends[place_b[cut_b]]


class Stripes:
    """Ids of side b dealt to stripes, so that a stripe's matrix of its ids against all of side a has CELLS cells."""

    def __init__(self, n_a: int, n_b: int, cells: int = CELLS):
        self.n_a = n_a
        self.count = max(1, -(-n_b // max(1, cells // n_a)))
        self.rows = -(-n_b // self.count)
        self.cells = self.rows * n_a

    def key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The stripe and, below it, the cell."""
        return b % self.count * np.int64(self.cells) + b // self.count * self.n_a + a


# ---------------------------------------------------------------- packed rows


def _packed(*columns: np.ndarray) -> bytes:
    return bytes(pa.compress(b"".join(c.tobytes() for c in columns), "zstd"))


def _unpacked(body: bytes, sizes: list[int], kinds: list[str]) -> list[np.ndarray]:
    raw = pa.decompress(body, sum(n * np.dtype(k).itemsize for n, k in zip(sizes, kinds)), "zstd")
    out, at = [], 0
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


FOUND = "kind string, block long, place int, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, stripe int, n_pairs int, n_links int, links binary, pairs binary"


def _found(**columns) -> pa.RecordBatch:
    """A batch of FOUND with the given columns; the others are null."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in FOUND.split(", ")]
    n = len(columns["block"])
    return pa.RecordBatch.from_arrays([pa.array([columns["kind"]] * n, pa.string()) if f == "kind" else pa.array(columns[f], kinds[k]) if f in columns else pa.nulls(n, kinds[k]) for f, k in fields], names=[f for f, _ in fields])


def _pair_rows(keys: np.ndarray, counts: np.ndarray, stripes: Stripes, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of at most ``most`` pairs of a stripe with their counts."""
    of = keys // stripes.cells
    bounds = np.searchsorted(of, np.arange(stripes.count + 1))
    cuts = np.unique(np.concatenate([np.arange(a, b, most) for a, b in zip(bounds, bounds[1:])] or [np.zeros(0, np.int64)])).astype(np.int64)
    rows = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]))
    for at in range(0, len(rows), 64):
        part = rows[at : at + 64]
        bodies = [_packed((keys[a:b] % stripes.cells).astype(np.uint32), counts[a:b].astype(np.int64)) for a, b in part]
        yield _found(kind="c", block=[None] * len(part), stripe=[int(of[a]) for a, _ in part], n_pairs=[b - a for a, b in part], pairs=bodies)


def _link_rows(keys: np.ndarray, own: np.ndarray, block: int, stripes: Stripes, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of at most ``most`` links of a stripe: its cells, how often each, and the texts in their order."""
    of = keys // stripes.cells
    bounds = np.searchsorted(of, np.arange(stripes.count + 1))
    rows = [(k, a, min(a + most, bounds[k + 1])) for k in np.flatnonzero(np.diff(bounds)).tolist() for a in range(bounds[k], bounds[k + 1], most)]
    for at in range(0, len(rows), 64):
        part, bodies, pairs = rows[at : at + 64], [], []
        for _, a, b in part:
            cells, many = _counted(keys[a:b] % stripes.cells, np.ones(b - a, np.int64))
            bodies.append(_packed(np.diff(cells, prepend=0).astype(np.uint32), many.astype(np.uint16), own[a:b].astype(np.uint32)))
            pairs.append(len(cells))
        yield _found(kind="l", block=[block] * len(part), stripe=[k for k, _, _ in part], n_pairs=pairs, n_links=[int(b - a) for _, a, b in part], links=bodies)


def _encoded_blocks(docs: DataFrame, stripes: Stripes, file_a: str | None, file_b: str | None, keep_groups: bool) -> DataFrame:
    """For each block of texts: a row a document (kind d), its links by stripe (l), and each task's pair counts by stripe (c)."""

    def run(batches):
        from pyspark import TaskContext

        a, b = encoders(file_a, file_b)
        block, pending, waiting = TaskContext.get().partitionId() << 36, [], 0
        for batch in batches:
            for part in chunks(batch, "text", BLOCK_BYTES):
                ids_a, at_a, ids_b, at_b = encoded(part.column("text"), a, b)
                cut_a, cut_b = linked(ids_a, a.spelled.lengths(ids_a), ids_b, b.spelled.lengths(ids_b))
                text, ends = group_texts(ids_a, cut_a, ids_b, cut_b)
                groups_at = np.append(0, np.cumsum(cut_b))[at_b]  # each text's groups
                text_at, raw = np.append(0, ends)[groups_at].tolist(), memoryview(text.tobytes())
                shown = [raw[x : y - 1] if y > x else b"" for x, y in zip(text_at, text_at[1:])]
                yield _found(
                    kind="d", block=np.full(part.num_rows, block), place=np.arange(part.num_rows), doc_id=part.column("doc_id"), n_a=np.diff(at_a), n_b=np.diff(at_b), n_groups=np.diff(groups_at),
                    groups_sha256=[hashlib.sha256(s).hexdigest() if len(s) else "" for s in shown], groups=[bytes(s).decode() if keep_groups else None for s in shown],
                )
                own = np.repeat(np.arange(part.num_rows), np.diff(groups_at))
                keys = stripes.key(ids_a[cut_a], ids_b[cut_b])
                order = np.argsort(keys, kind="stable")
                yield from _link_rows(keys[order], own[order], block, stripes, ROW_LINKS)
                pending.append(_counted(keys[order], np.ones(len(keys), np.int64)))
                waiting += len(pending[-1][0])
                if waiting > PENDING_PAIRS:
                    pending = [_counted(*map(np.concatenate, zip(*pending)))]
                    waiting = len(pending[0][0])
                    if waiting > PENDING_PAIRS // 2:
                        yield from _pair_rows(*pending[0], stripes, ROW_LINKS)
                        pending, waiting = [], 0
                block += 1
        if pending:
            yield from _pair_rows(*_counted(*map(np.concatenate, zip(*pending))), stripes, ROW_LINKS)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return split_table(slim, docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(giving_back(run), FOUND)


def _pair_counts(found: DataFrame, stripes: Stripes) -> DataFrame:
    """Every linked pair of ids, its count over the corpus, and whether no id of side a has a higher one with its b."""

    def run(batches):
        def rows():
            cells = np.flatnonzero(matrix)
            counts = matrix.ravel()[cells]
            best = counts == matrix.max(axis=1)[cells // stripes.n_a]
            out = [np.full(len(cells), at), cells % stripes.n_a, cells // stripes.n_a * stripes.count + at, counts, best]
            for k in range(0, len(cells), 1 << 16):
                part = [c[k : k + (1 << 16)] for c in out]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["stripe", "a", "b", "count", "best"])

        at, matrix = None, np.zeros((stripes.rows, stripes.n_a), np.int64)
        for (stripe,), part in slices(batches, "stripe"):
            if stripe != at:
                if at is not None:
                    yield from rows()
                    matrix[:] = 0
                at = stripe
            for n, body in zip(part.column("n_pairs").to_pylist(), part.column("pairs").to_pylist()):
                cells, counts = _unpacked(body, [n, n], ["<u4", "<i8"])
                np.add.at(matrix.reshape(-1), cells.astype(np.int64), counts)
        if at is not None:
            yield from rows()

    rows = found.where("kind = 'c'").select("stripe", "n_pairs", "pairs").repartition("stripe").sortWithinPartitions("stripe")
    return rows.mapInArrow(giving_back(run), "stripe int, a long, b long, count long, best boolean")


def _partial_scores(found: DataFrame, counts: DataFrame, stripes: Stripes) -> DataFrame:
    """Of each row of links, its texts' number of best links and sum of counts, where the stripe's matrix is.

    A stripe of more than PART_LINKS links is scored in parts: its blocks are dealt by
    hash, and its counts go to each part.
    """
    parts = counts.groupBy("stripe").agg(F.expr(f"cast(ceil(sum(count) / {PART_LINKS}) as int)").alias("parts"))
    parts = F.broadcast(parts)  # a row a stripe: as many as the vocabularies make
    links = found.where("kind = 'l'").join(parts, "stripe").select("stripe", F.expr("cast(pmod(xxhash64(block), parts) as int)").alias("part"), F.lit(1).alias("turn"), "block", "n_pairs", "n_links", "links")
    cells = counts.join(parts, "stripe").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select("stripe", "part", F.lit(0).alias("turn"), "a", "b", "count", "best")

    def run(batches):
        matrix, best = np.zeros(stripes.cells, np.int64), np.zeros(stripes.cells, bool)
        for (_, turn), part in slices(batches, "stripe", "turn"):
            column = lambda name: part.column(part.schema.get_field_index(name))
            if turn == 0:
                at = column("b").to_numpy() // stripes.count * stripes.n_a + column("a").to_numpy()
                matrix[at], best[at] = column("count").to_numpy(), column("best").to_numpy(zero_copy_only=False)
                continue
            out = []
            for block, n, m, body in zip(*(column(c).to_pylist() for c in ("block", "n_pairs", "n_links", "links"))):
                steps, many, own = _unpacked(body, [n, n, m], ["<u4", "<u2", "<u4"])
                at = np.repeat(np.cumsum(steps.astype(np.int64)), many)
                texts, which = np.unique(own, return_inverse=True)
                total, highest = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                np.add.at(total, which, matrix[at])
                np.add.at(highest, which, best[at].astype(np.int64))
                out.append((block, len(texts), _packed(texts.astype(np.uint32), highest.astype(np.uint32), total)))
            block, n, body = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(n, pa.int32()), pa.array(body, pa.binary())], names=["block", "n_texts", "scores"])

    rows = cells.unionByName(links, allowMissingColumns=True).repartition("stripe", "part").sortWithinPartitions("stripe", "part", "turn")
    return rows.mapInArrow(giving_back(run), "block long, n_texts int, scores binary")


def _added(found: DataFrame, scores: DataFrame) -> DataFrame:
    """The rows of documents with their links' scores, block by block."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups"]

    def run(batches):
        at, texts, best, total = None, [], None, None

        def rows():
            held = pa.Table.from_batches(texts).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*(held.column(held.schema.get_field_index(c)) for c in names), pa.array(best), pa.array(total)], names=[*names, "n_best", "count_sum"])

        for (block, turn), part in slices(batches, "block", "turn"):
            if block != at:
                if texts:
                    yield rows()
                at, texts, best, total = block, [], np.zeros(0, np.int64), np.zeros(0, np.int64)
            if turn == 0:
                texts.append(part)
                best, total = (np.append(x, np.zeros(part.num_rows, np.int64)) for x in (best, total))
                continue
            for n, body in zip(part.column(part.schema.get_field_index("n_texts")).to_pylist(), part.column(part.schema.get_field_index("scores")).to_pylist()):
                own, highest, sums = _unpacked(body, [n, n, n], ["<u4", "<u4", "<i8"])
                best[own] += highest
                total[own] += sums
        if texts:
            yield rows()

    texts = found.where("kind = 'd'").select("block", F.lit(0).alias("turn"), "place", *names)
    scores = scores.select("block", F.lit(1).alias("turn"), "n_texts", "scores")
    rows = texts.unionByName(scores, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "turn", "place")
    return rows.mapInArrow(giving_back(run), "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, n_best long, count_sum long")


def align_tokenizers(docs: DataFrame, file_a: str | None = None, file_b: str | None = None, keep_groups: bool = True) -> tuple[DataFrame, DataFrame]:
    """Documents with their aligned groups and scores, and the table of linked pairs of ids.

    Side a: byte-level ids of a space and the text; side b: piece ids of the text, before
    which the library puts a space.  A link is a pair of tokens that end at the same
    byte; such bytes cut the tokens into groups, ``groups`` is ``a1,a2|b1;a3|b2``.
    Documents: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count over the
    corpus is the highest of their b id, ties included), count_sum (of the links'
    counts), groups_sha256, groups (null without ``keep_groups``).  Pairs: stripe, a, b,
    count, best.

    One row for each row of ``docs`` (doc_id, text), which need not be distinct and may
    have a null id; other columns are ignored.  Null and empty texts, and texts that
    either side does not spell exactly (those with U+2581), have no tokens: zeros, and
    '' for the groups and their digest.
    """
    a, b = encoders(file_a, file_b)
    stripes = Stripes(len(a.bytes_of), len(b.bytes_of))
    found = materialize(_encoded_blocks(docs, stripes, file_a, file_b, keep_groups), "linked")
    counts = materialize(_pair_counts(found, stripes), "pairs")
    scored = _added(found, _partial_scores(found, counts, stripes))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256", "groups"), counts
