"""Probabilistic suffix tree: contexts of up to two words, kept by a divergence test, score each next word.

The alphabet is words and one end mark.  The root is the additively smoothed word
distribution.  A context state is kept if what its next-word counts save against
its parent's distribution, in nats, exceeds the cost of naming each of its next
words once, by THRESHOLD.  A token is scored by the longest kept suffix of the words
before it: max(c - D, 0) / n for a next word seen there c of n times, and the discounted mass
D * kinds / n times the parent's probability.  So each state's probabilities add up to
those of the root, which add up to one with one unknown word.

Two shuffles of token events do all of it.  The first deals events by the last
context word, so a whole subtree (its counts, tests and scores) is in one task; the
second deals infrequent words by themselves, for their exact counts at the root.
Events travel as compressed column blocks, a row for each block of documents and
bucket.  Words that make up at least 1/65536 of the training tokens, 65536 at most,
are counted first and known everywhere; so no frequent word is ever one task's load.
As contexts the most frequent ones are split, by the word before them and, where a pair
of words is itself too frequent, by a hash of the document.  The whole training counts of
split contexts are summed up before, and travel to each of their parts: so every
state is tested and scored with its counts over all training documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import _BASE, chunks, fold_of, giving_back, group_by_group, materialize, mix64, split_table, word_hashes

DISCOUNT = 0.5
THRESHOLD = 3.0
FREQUENT = 1 << 16
CLASSES = 1 << 20
BLOCK_CHARS = 4_000_000  # text that is dealt at a time
BUCKET_CHARS = 16_000_000  # text whose tokens make up a bucket of the first shuffle
PAIRS = 1 << 20  # counts of split contexts that a task holds before it deals them
EVENTS = 1 << 18  # events of a bucket whose states are weighed at a time
KEPT_BITS = np.uint64(0xFFFFFFFFFFFF0000)  # 48 bits tell words, and contexts of one word, apart: of ten million words, a pair is alike once in six corpora
END, BEGIN = np.uint64(0xE17D000000000001), np.uint64(0xBE61000000000001)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any integer kinds: byte planes apart, compressed."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    parts = [press.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()) for a in arrays]
    head = np.array([x for a, p in zip(arrays, parts) for x in (len(a), a.itemsize, len(p))], "<u4")
    return np.uint32(len(arrays)).tobytes() + head.tobytes() + b"".join(parts)


def _unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    head = np.frombuffer(blob, "<u4", 3 * n, 4).reshape(n, 3).astype(int)
    at, out = 4 + 12 * n, []
    for length, size, packed in head:
        raw = press.decompress(blob[at : at + packed], max_output_size=length * size) if length else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, length).T).view(f"<u{size}").reshape(-1))
        at += packed
    return out


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of an array in order, and how often each stands there."""
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
    return ordered[first], np.diff(np.append(first, len(ordered))).astype(np.uint32)


def _blocks(batches):
    """(doc ids, held out, tokens with end marks, bounds) of blocks of documents."""
    for batch in batches:
        for block in chunks(batch, "text", BLOCK_CHARS):
            parts, sizes = [], []
            for part in chunks(block, "text"):
                hashes, at = word_hashes(part.column("text"))
                parts.append(np.insert(hashes & KEPT_BITS, at[1:], END))
                sizes.append(np.diff(at) + 1)
            n = np.concatenate(sizes)
            yield block.column("doc_id"), np.array(block.column("held_out").to_pylist(), bool), np.concatenate(parts), np.append(0, np.cumsum(n))


def _split_by(key: np.ndarray, buckets: int):
    """Rows in order of their bucket (the top bits of a mixed key, so a bucket is a range of keys), and its bounds."""
    bits = buckets.bit_length() - 1
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    return bucket, np.searchsorted(np.sort(bucket), np.arange(buckets + 1))


def count_words(docs: DataFrame, buckets: int):
    """Training tokens, distinct ones, the frequent words with their counts, and token counts of CLASSES ranges of hashes."""

    def count(batches):
        for _, held, tokens, bounds in _blocks(batches):
            train = tokens[np.repeat(~held, np.diff(bounds))]
            word, n = np.unique(train, return_counts=True)
            cut = _split_by(word, buckets)[1]
            for b in range(buckets):
                if cut[b] < cut[b + 1]:
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([_pack(word[cut[b] : cut[b + 1]], n[cut[b] : cut[b + 1]].astype(np.uint32))], pa.binary())], names=["bucket", "words"])

    def merge(table: pa.Table) -> pa.Table:
        found = [_unpack(x) for x in table.column("words").to_pylist()]
        word, at = np.unique(np.concatenate([w for w, _ in found]), return_inverse=True)
        n = np.bincount(at, np.concatenate([c for _, c in found])).astype(np.int64)
        top = np.sort(np.argsort(-n, kind="stable")[:FREQUENT])
        classes = np.bincount((word >> np.uint64(44)).astype(np.int64), n)
        used = np.flatnonzero(classes)
        return pa.table({"n": [int(n.sum())], "v": [len(word)], "top": [_pack(word[top], n[top].astype(np.uint64))], "classes": [_pack(used.astype(np.uint32), classes[used].astype(np.uint64))]})

    rows = docs.mapInArrow(giving_back(count), "bucket int, words binary").groupBy("bucket").applyInArrow(group_by_group(merge), "n long, v long, top binary, classes binary")
    rows = materialize(rows, "words")
    n, v = (int(x or 0) for x in rows.agg(F.sum("n"), F.sum("v")).first())

    def frequent(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                word, c = _unpack(blob)
                keep = c.astype(np.float64) * FREQUENT >= n
                yield pa.RecordBatch.from_arrays([pa.array(word[keep].view(np.int64)), pa.array(c[keep].astype(np.int64))], names=["word", "n"])

    table = rows.select("top").mapInArrow(frequent, "word long, n long").toArrow()  # FREQUENT rows at most
    word = table.column("word").to_numpy().view(np.uint64)
    order = np.argsort(word)
    classes = np.zeros(CLASSES, np.uint32)
    for row in rows.select("classes").toLocalIterator():  # CLASSES counts in all
        used, c = _unpack(row["classes"])
        classes[used] = np.minimum(c, 0xFFFFFFFF)
    return n, v, word[order], table.column("n").to_numpy()[order], classes


def _place(sorted_words: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Index among the frequent words, or their number where a word is not one."""
    if not len(sorted_words):
        return np.zeros(len(words), np.int64)
    at = np.searchsorted(sorted_words, words)
    at[at == len(sorted_words)] = 0
    return np.where(sorted_words[at] == words, at, len(sorted_words))


def _before(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last word before each token and the one before that; BEGIN where there is none."""
    starts = np.zeros(len(tokens), bool)
    starts[bounds[:-1]] = True
    w1 = np.where(starts, BEGIN, np.roll(tokens, 1))
    return w1, np.where(starts, BEGIN, np.roll(w1, 1))


def _pair(w2: np.ndarray, w1: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(w2 * _BASE + w1)


def _part_key(w1: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The name of a part of a context; the bucket is in its top bits."""
    with np.errstate(over="ignore"):
        return mix64(w1 + part.astype(np.uint64) * _BASE) & KEPT_BITS


def _added(state: np.ndarray, word: np.ndarray, n: np.ndarray):
    """Counts of equal (state, word) added up, and their keys in order."""
    key, first, at = np.unique(_pair(state.astype(np.uint64), word), return_index=True, return_inverse=True)
    return key, state[first], word[first], np.bincount(at, n, len(first)).astype(np.uint64)


def count_next(docs: DataFrame, states: np.ndarray, words: int, groups: int) -> DataFrame:
    """counts: (number of the state, next word, n) over all training documents, packed and in order of the state.

    ``states`` are sorted words, or sorted pairs (``words`` = 2).  Each (state, word) is in one row only.
    """

    def dealt(key, state, word, n):
        cut = _split_by(key, groups)[1]
        for g in range(groups):
            own = slice(cut[g], cut[g + 1])
            if cut[g] < cut[g + 1]:
                order = np.lexsort((word[own], state[own]))
                blob = _pack(*(x[own][order] for x in (state, word, n)))
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([blob], pa.binary())], names=["group", "counts"])

    def count(batches):
        sums = None
        for _, held, tokens, bounds in _blocks(batches):
            w1, w2 = _before(tokens, bounds)
            state = _place(states, w1 if words == 1 else _pair(w2, w1))
            own = np.flatnonzero((state < len(states)) & np.repeat(~held, np.diff(bounds)))
            found = state[own].astype(np.uint32), tokens[own], np.ones(len(own), np.uint64)
            sums = _added(*(found if sums is None else (np.concatenate(x) for x in zip(sums[1:], found))))
            if len(sums[0]) > PAIRS:
                yield from dealt(*sums)
                sums = None
        if sums is not None:
            yield from dealt(*sums)

    def merge(table: pa.Table) -> pa.Table:
        _, state, word, n = _added(*(np.concatenate(x) for x in zip(*(_unpack(b) for b in table.column("counts").to_pylist()))))
        order = np.lexsort((word, state))
        return pa.table({"counts": [_pack(state[order], word[order], n[order])]})

    return docs.mapInArrow(giving_back(count), "group int, counts binary").groupBy("group").applyInArrow(group_by_group(merge), "counts binary")


def _send(counts: DataFrame, kind: int, state: np.ndarray, key: np.ndarray, short: np.ndarray, buckets: int) -> DataFrame:
    """The counts of ``state`` as rows for the bucket of each of its parts (``key``, and ``short`` of the farther word)."""
    bits = buckets.bit_length() - 1
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64)

    def run(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                of, word, n = _unpack(blob)
                low, high = np.searchsorted(of, state), np.searchsorted(of, state, "right")
                for b in np.unique(bucket[low < high]).tolist():
                    own = np.flatnonzero((bucket == b) & (low < high))
                    at = np.concatenate([np.arange(i, j) for i, j in zip(low[own], high[own])])
                    yield _row(b, -1, kind, 0, _pack(key[own], short[own], (high - low)[own], word[at], n[at]))

    return counts.mapInArrow(run, ROW)


def _home(block: int, buckets: int) -> int:
    """The bucket that a block's sums travel in; blocks count up from a partition's number << 24."""
    return ((block >> 24) + block % (1 << 24)) % buckets


def _short(words: np.ndarray) -> np.ndarray:
    """32 bits of a context's farther word, which tell it apart beside its nearer one."""
    return (mix64(words ^ np.uint64(0x77)) >> np.uint64(32)).astype(np.uint32)


def _weights(state: np.ndarray, n_states: int, train: np.ndarray, counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """What each event counts for, then each row of ``counts``: events of a state whose ``whole`` counts are there count nothing."""
    split = np.zeros(n_states, bool)
    split[state[len(train) :][whole]] = True
    return np.concatenate([train & ~split[state[: len(train)]], np.where(whole, counts, 0)])


def _keep_states(state: np.ndarray, n_states: int, word: np.ndarray, weight: np.ndarray, parent: np.ndarray):
    """For each event: is its state kept, counts of (state, word), the state's count and kinds; ``parent``: log P(word | parent)."""
    with np.errstate(over="ignore"):
        key = mix64(state.astype(np.uint64) * _BASE + word)
    _, first, pair = np.unique(key, return_index=True, return_inverse=True)
    del key
    c = np.bincount(pair, weight).astype(np.int64)
    n = np.bincount(state, weight, n_states).astype(np.int64)
    of = state[first]
    live = c > 0
    kinds = np.bincount(of[live], minlength=n_states).astype(np.int32)
    own, cl, above = of[live], c[live], parent[first][live]
    saved = cl * (np.log(cl / n[own]) - above) + above
    kept = (np.bincount(own, saved, n_states) > THRESHOLD) & (n >= 2)
    return kept[state], c[pair], n[state], kinds[state]


def _discounted(kept: np.ndarray, c: np.ndarray, n: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What an event's state gives its word, and the share that it leaves to its parent; a state that is not kept leaves all."""
    n = np.maximum(n, 1)
    return np.where(kept, np.maximum(c - DISCOUNT, 0) / n, 0.0), np.where(kept, DISCOUNT * kinds / n, 1.0)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text).

    Rows with crc32(doc_id) mod 5 = 1 are held out, the others train.  Null and empty
    texts are the end mark alone.  Rows without doc_id train.  Repeated rows train and
    are scored each.  Without training rows every token has the same probability.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(fold_of("doc_id", 5) == 1, F.lit(False)))
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    buckets = 1 << max(0, math.ceil(math.log2(max(1, chars / BUCKET_CHARS))))
    second = max(1, buckets // 2)
    spread = split_table(rows, spark.sparkContext.defaultParallelism)
    n_train, kinds, frequent, counts, classes = count_words(spread, buckets)
    log_z = math.log10(n_train + 0.5 * (kinds + 1))
    hot = max(1.0, n_train / buckets / 4)
    # contexts to split: BEGIN is as frequent as END, which is no context
    names, sizes = np.where(frequent == END, BEGIN, frequent), counts
    over = (sizes > hot) & (buckets > 1)
    split, sizes = names[over], sizes[over]
    split, sizes = split[np.argsort(split)], sizes[np.argsort(split)]
    n_parts = np.ceil(sizes / hot).astype(np.uint64)
    pairs, pair_parts, learned = np.zeros(0, np.uint64), np.zeros(0, np.uint64), []
    if len(split):
        singles = materialize(count_next(spread, split, 1, second), "split-contexts")

        def frequent_pairs(batches):
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    of, word, n = _unpack(blob)
                    own = np.flatnonzero((n > hot) & (_place(split, word) < len(split)))
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (of[own], _place(split, word[own]), n[own])], names=["farther", "nearer", "n"])

        found = singles.mapInArrow(frequent_pairs, "farther long, nearer long, n long").toArrow()  # 4 * buckets rows at most
        farther, nearer, n = (c.to_numpy() for c in found.columns)
        if BEGIN in split:  # before the first word are two of them
            begin = _place(split, np.array([BEGIN]))[0]
            farther, nearer, n = np.append(farther, begin), np.append(nearer, begin), np.append(n, sizes[begin])
        order = np.argsort(_pair(split[farther], split[nearer]))
        farther, nearer, n = farther[order], nearer[order], n[order]
        pairs = _pair(split[farther], split[nearer])
        pair_parts = np.minimum(np.ceil(n / hot).astype(np.uint64), n_parts[nearer])
        every = lambda parts: (np.repeat(np.arange(len(parts)), parts.astype(int)), np.concatenate([np.arange(p, dtype=np.uint64) for p in parts.tolist()]))
        of, part = every(n_parts)
        learned.append(_send(singles, 5, of, _part_key(split[of], part), np.zeros(len(of), np.uint32), buckets))
        if len(pairs):
            of, part = every(pair_parts)
            near, far = nearer[of], split[farther[of]]
            learned.append(_send(count_next(spread, pairs, 2, second), 6, of, _part_key(split[near], (mix64(far) % n_parts[near] + part) % n_parts[near]), _short(far), buckets))
    # frequent words travel as their rank by count, from 1 (0: another word), so that most bytes are alike
    by_rank = np.append(len(frequent), np.argsort(-counts, kind="stable")).astype(np.int64)
    rank = np.zeros(len(by_rank), np.uint32)
    rank[by_rank[1:]] = np.arange(1, len(by_rank))
    shorts = _short(frequent)

    def deal(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        logs = np.log10(np.append(counts, 0) + 0.5)
        for doc_ids, held, tokens, bounds in _blocks(batches):
            n_docs = len(held)
            doc = np.repeat(np.arange(n_docs, dtype=np.uint32), np.diff(bounds))
            at = _place(frequent, tokens)
            known = at < len(frequent)
            base = np.bincount(doc, logs[at] * known, n_docs)
            n_known = np.bincount(doc, known, n_docs).astype(np.int64)
            starts = np.zeros(len(tokens), bool)
            starts[bounds[:-1]] = True
            w1, w2 = _before(tokens, bounds)
            at1 = np.where(starts, len(frequent), np.roll(at, 1))
            at2 = np.where(starts, len(frequent), np.roll(at1, 1))
            part = np.zeros(len(tokens), np.uint64)
            place = _place(split, w1)
            own = np.flatnonzero(place < len(split))
            if len(own):
                most = n_parts[place[own]]
                shared = np.append(pair_parts, np.uint64(1))[_place(pairs, _pair(w2[own], w1[own]))]
                part[own] = (mix64(w2[own]) % most + mix64(doc[own].astype(np.uint64) + np.uint64(block << 8)) % shared) % most
            key, short = _part_key(w1, part), _short(w2)
            del w1, w2, at1, part, place, own, starts
            order = np.argsort(key, kind="stable")
            cut = _split_by(key[order], buckets)[1]
            train = (~held)[doc]
            for b in range(buckets):
                own = order[cut[b] : cut[b + 1]]
                if len(own):
                    before, now = rank[at2[own]], rank[at[own]]
                    blob = _pack(*_runs(key[own]), before, short[own[before == 0]], now, tokens[own[now == 0]], (doc[own] << np.uint32(1)) | train[own])
                    yield _row(b, block, 1, n_docs, blob)
            facts = _pack(np.diff(bounds).astype(np.uint64), n_known.astype(np.uint64), base.view(np.uint64), held.astype(np.uint8))
            yield _row(_home(block, second), block, 0, n_docs, facts, doc_ids)
            block += 1

    def weigh(key, short, at, word, tag, whole):
        """For each event: is its word a rare one, what its contexts saw of it against what they leave to the root, its score (of a rare word, without the root's part); ``whole``: counts of split contexts."""
        logs = np.log(np.append(counts, 1) / max(n_train, 1))
        rough = np.log(np.maximum(classes, 1) / max(n_train, 1))
        events, train = len(key), (tag & 1).astype(bool)
        level, *more, sums = whole
        key, short, at, word = (np.concatenate(x) for x in zip((key, short, at, word), more))
        is_rare = at == len(frequent)
        root = np.where(is_rare, rough[(word >> np.uint64(44)).astype(np.int64)], logs[at])
        names, state = np.unique(key, return_inverse=True)
        kept1, c1, n1, kinds1 = _keep_states(state, len(names), word, _weights(state, len(names), train, sums, level == 5), root)
        with np.errstate(over="ignore"):
            part1, rest1 = _discounted(kept1, c1, n1, kinds1)
            parent = np.log(part1 + rest1 * np.exp(root))
            del state, kept1, c1, n1, kinds1
            two = np.append(np.ones(events, bool), level == 6)
            key, short, parent = key[two], short[two], parent[two]
            names, state = np.unique(mix64(key + short.astype(np.uint64) * _BASE), return_inverse=True)
            del key, short, root
            sums = sums[level == 6]
            kept2, c2, n2, kinds2 = _keep_states(state, len(names), word[two], _weights(state, len(names), train, sums, np.ones(len(sums), bool)), parent)
            del state, names, parent, train, two
        part2, rest2 = _discounted(kept2[:events], c2[:events], n2[:events], kinds2[:events])
        del kept2, c2, n2, kinds2
        is_rare, at, part1, rest1 = is_rare[:events], at[:events], part1[:events], rest1[:events]
        # the probability is seen + rest * the root's
        seen, rest = part2 + rest2 * part1, rest2 * rest1
        own = (np.append(counts, 0)[at] + 0.5) / 10**log_z
        score = np.where(is_rare, np.log10(rest), np.log10(seen + rest * own))
        return is_rare, (seen / rest).astype(np.float32), score

    def contexts(table: pa.Table) -> pa.Table:
        out = _Rows()
        summed = _whole(table)
        events = out.take(table, 1)
        if not events:
            return out.table()
        for _, _, x in events:
            x[:2] = [np.repeat(x[0], x[1].astype(np.int64))]
        words_of, shorts_of = np.append(frequent, np.uint64(0)), np.append(np.uint32(0), shorts[by_rank[1:]])
        bucket, total = table.column("bucket")[0].as_py(), sum(len(x[0]) for _, _, x in events) + len(summed[0])
        bits = buckets.bit_length() - 1
        parts = 1 << min(12, max(0, math.ceil(math.log2(total / EVENTS))))
        edges = np.array([((bucket << 64) // buckets) + (i << (64 - bits)) // parts for i in range(1, parts)], np.uint64)
        cuts = [np.concatenate(([0], np.searchsorted(x[0], edges), [len(x[0])])) for _, _, x in events]
        reach = np.concatenate(([0], np.searchsorted(summed[1], edges), [len(summed[1])]))
        used = [[0, 0] for _ in events]  # farther and next words that are no frequent ones, of the parts before
        sums = [np.zeros(n_docs) for _, n_docs, _ in events]
        others: list[list] = [[] for _ in events]
        for part in range(parts):
            pieces = []
            for cut, skip, (_, _, (key, before, short, now, rare, tag)) in zip(cuts, used, events):
                i, j = cut[part], cut[part + 1]
                far, new = before[i:j] == 0, now[i:j] == 0
                s2, s0 = skip
                skip[:] = s2 + np.count_nonzero(far), s0 + np.count_nonzero(new)
                whole = shorts_of[before[i:j]]
                whole[far] = short[s2 : skip[0]]
                at = by_rank[now[i:j]]
                word = words_of[at]
                word[new] = rare[s0 : skip[1]]
                pieces.append((key[i:j], whole, at, word, tag[i:j]))
            lengths = [len(p[0]) for p in pieces]
            if not sum(lengths):
                continue
            key, short, at, word, tag = (np.concatenate(x) for x in zip(*pieces))
            del pieces
            level, k1, k2, w, n = (x[reach[part] : reach[part + 1]] for x in summed)
            is_rare, ratio, score = weigh(key, short, at, word, tag, (level, k1, k2, _place(frequent, w), w, n))
            begin = 0
            for k, length in enumerate(lengths):
                rows = slice(begin, begin + length)
                begin = rows.stop
                sums[k] += np.bincount((tag[rows] >> 1).astype(np.int64), score[rows], len(sums[k]))
                rare = np.flatnonzero(is_rare[rows])
                others[k].append((word[rows][rare], tag[rows][rare], ratio[rows][rare]))
        met = [np.unique(x[5] >> 1) for _, _, x in events]
        for _, _, x in events:
            x.clear()
        del summed
        found = [[np.zeros(0, kind) for kind in (np.uint64, np.uint32, np.float32, np.int64)]]
        # only of documents that have events here, so that all sums together are no more than events, however many buckets
        for (block, n_docs, _), doc, total, parts_of in zip(events, met, sums, others):
            out.add(_home(block, second), block, 2, n_docs, _pack(doc, total[doc].view(np.uint64)))
            found += [[*x, np.full(len(x[0]), block)] for x in parts_of]
        # rare words of all blocks together: a row for each second bucket, however many blocks there are
        w, t, r, of = (np.concatenate(x) for x in zip(*found))
        del found, others
        order = np.argsort(w, kind="stable")
        cut = _split_by(w[order], second)[1]
        for b in range(second):
            own = order[cut[b] : cut[b + 1]]
            if len(own):
                part, place = of[own] >> 24, of[own] & 0xFFFFFF
                out.add(b, -1, 3, 0, _pack(*_runs(w[own]), part.astype(np.uint32), place.astype(np.uint32), t[own], r[own].view(np.uint32)))
        return out.table()

    def roots(table: pa.Table) -> pa.Table:
        out = _Rows()
        events = out.take(table, 3)
        if not events:
            return out.table()
        for _, _, x in events:
            x[:2] = [np.repeat(x[0], x[1].astype(np.int64))]
        word, part, place, tag, ratio = (np.concatenate(x) for x in zip(*(x for _, _, x in events)))
        of = (part.astype(np.int64) << 24) | place
        # in a fixed order, so that sums do not depend on the order of arrival
        order = np.lexsort((ratio, tag, word, of))
        word, of, tag, ratio = word[order], of[order], tag[order], ratio[order].view(np.float32)
        del part, place, order, events
        _, at = np.unique(word, return_inverse=True)
        c = np.bincount(at, tag & 1)[at]
        del at, word
        logs = np.log10(c + 0.5)
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        for a, z in zip(first.tolist(), [*first[1:].tolist(), len(of)]):
            (met, doc), seen = np.unique(tag[a:z] >> 1, return_inverse=True), c[a:z]
            base, known, score = np.bincount(doc, logs[a:z]), np.bincount(doc, seen > 0), np.bincount(doc, np.log10(ratio[a:z] + (seen + 0.5) / 10**log_z))
            out.add(0, int(of[a]), 4, len(met), _pack(met, base.view(np.uint64), known.astype(np.uint32), score.view(np.uint64)))
        return out.table()

    def close(table: pa.Table) -> pa.Table:
        kind, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        at = kind.index(0)
        tokens, known, base, held = _unpack(blobs[at])
        base, known, score = base.view(np.float64).copy(), known.astype(np.int64), np.zeros(len(tokens))
        # in a fixed order, so that sums do not depend on the order of arrival
        for k, blob in sorted((k, b) for k, b in zip(kind, blobs) if k):
            doc, *found = _unpack(blob)
            if k == 4:
                base[doc] += found[0].view(np.float64)
                known[doc] += found[1].astype(np.int64)
            score[doc] += found[-1].view(np.float64)
        tokens = tokens.astype(np.int64)
        return pa.table({"doc_id": table.column("docs")[at].values, "held_out": held.astype(bool), "n_tokens": tokens, "n_known": known, "train_tokens": np.full(len(tokens), n_train), "base_score": base - tokens * log_z, "score": score})

    dealt = spread.mapInArrow(giving_back(deal), ROW)
    for rows in learned:
        dealt = dealt.unionByName(rows)
    flow = dealt.groupBy("bucket").applyInArrow(group_by_group(contexts), ROW).groupBy("bucket").applyInArrow(group_by_group(roots), ROW)
    return flow.groupBy("block").applyInArrow(group_by_group(close), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


ROW = "bucket int, block long, kind int, n_docs int, blob binary, docs array<long>"
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
_NAMES = ["bucket", "block", "kind", "n_docs", "blob", "docs"]


def _row(bucket: int, block: int, kind: int, n_docs: int, blob: bytes, docs=None) -> pa.RecordBatch:
    values = [[bucket], [block], [kind], [n_docs], [blob], [docs.to_pylist() if docs is not None else None]]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, _KINDS)], names=_NAMES)


def _whole(table: pa.Table) -> list[np.ndarray]:
    """Level (5: contexts of a word, 6: of two), key, short, next word and count of a table's split contexts, in order of the key."""
    found = [np.zeros(0, k) for k in (np.int64, np.uint64, np.uint32, np.uint64, np.int64)]
    parts = [found]
    blobs = table.column("blob")
    for i, kind in enumerate(table.column("kind").to_pylist()):
        if kind < 5:
            continue
        key, short, length, word, n = _unpack(blobs[i].as_py())
        length = length.astype(np.int64)
        parts.append([np.full(len(word), kind), np.repeat(key, length), np.repeat(short, length), word, n.astype(np.int64)])
    found = [np.concatenate(x) for x in zip(*parts)]
    order = np.argsort(found[1], kind="stable")
    return [x[order] for x in found]


class _Rows:
    """Rows of one task: those of a kind are unpacked, all others pass on, but for sums of split contexts."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.passed: list[pa.Table] = []

    def take(self, table: pa.Table, kind: int) -> list[tuple]:
        kinds = np.array(table.column("kind").to_pylist())
        rest = table.filter(pa.array((kinds != kind) & (kinds < 5)))
        if rest.num_rows:
            self.passed.append(rest.select(_NAMES))
        block, n_docs, blobs = (table.column(c) for c in ("block", "n_docs", "blob"))
        own = sorted((block[i].as_py(), i) for i in np.flatnonzero(kinds == kind).tolist())
        return [(b, n_docs[i].as_py(), _unpack(blobs[i].as_py())) for b, i in own]

    def add(self, *row) -> None:
        self.rows.append(row)

    def table(self) -> pa.Table:
        schema = pa.schema(list(zip(_NAMES, _KINDS)))
        made = pa.table({name: pa.array([r[i] for r in self.rows] if i < 5 else [None] * len(self.rows), kind) for i, (name, kind) in enumerate(zip(_NAMES, _KINDS))}, schema=schema)
        return pa.concat_tables([made, *(t.cast(schema) for t in self.passed)])
