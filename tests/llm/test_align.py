import collections
import hashlib
import random

import pytest


def plain_tokens():
    """Each side's encode function and the bytes of its ids, from the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    from textloom.llm.common import tokenizer_file

    tok = Tokenizer.from_file(tokenizer_file())
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in shown):
        byte_of[chr(256 + k)] = b

    def spell_b(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[1:-1], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()

    def spell_a(i):
        return bytes(byte_of[c] for c in tok.id_to_token(i))

    return (lambda t: tok.encode(" " + t, add_special_tokens=False).ids), spell_a, sp.encode, spell_b


def plain_rows(docs):
    encode_a, spell_a, encode_b, spell_b = plain_tokens()
    rows, count = [], collections.Counter()
    for doc_id, text in docs:
        a, b = (encode_a(text), encode_b(text)) if text else ([], [])
        if text and (b"".join(map(spell_a, a)) != (" " + text).encode() or b"".join(map(spell_b, b)) != (" " + text).encode()):
            a, b = [], []
        ends = [set(), set()]
        for k, (ids, spell) in enumerate(((a, spell_a), (b, spell_b))):
            at = 0
            for i in ids:
                at += len(spell(i))
                ends[k].add(at)
        common, groups, links = ends[0] & ends[1], [], []
        sides = []
        for ids, spell in ((a, spell_a), (b, spell_b)):
            at, parts, part = 0, [], []
            for i in ids:
                at += len(spell(i))
                part.append(i)
                if at in common:
                    parts.append(part)
                    part = []
            assert not part
            sides.append(parts)
        for x, y in zip(*sides, strict=True):
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
            links.append((x[-1], y[-1]))
        count.update(links)
        rows.append((doc_id, len(a), len(b), groups, links))
    top = collections.defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [
        (d, na, nb, len(g), len(ls), sum(count[x] == top[x[1]] for x in ls), sum(count[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, na, nb, g, ls in rows
    ]


def odd_docs():
    rng = random.Random(3)
    marks = [" ", " ", "\n", "\t", "a", "the", "Token", "é", "漢字", "😀", "　", "\xa0", "\x00", "1234", "'s", ".", "<|endoftext|>", "<s>", "<0x41>", "▁", "\r\n", "  ", "of the", "x" * 70, "½", "ﬁ"]
    docs = [(1, None), (2, ""), (3, " "), (4, "\n"), (5, "▁"), (6, "a▁b c"), (None, "no id at all"), (None, None), (7, "same row"), (7, "same row"), (8, "word " * 4000), (9, "   "), (10, "<|endoftext|>")]
    return docs + [(100 + k, "".join(rng.choice(marks) for _ in range(rng.randint(1, 60)))) for k in range(400)]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, monkeypatch, small):
    """Against the libraries' ids and plain counts; once with many small blocks, rows, and parts of stripes."""
    from textloom.llm import align

    if small:
        for name, n in (("BLOCK_BYTES", 500), ("ROW_LINKS", 7), ("PART_LINKS", 50), ("PENDING_PAIRS", 100)):
            monkeypatch.setattr(align, name, n)
    docs = odd_docs()
    table = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n_a int, stripe string")
    assert align.Stripes(50257, 32000).count > 100
    found, pairs = align.align_tokenizers(table)
    rows = found.collect()
    assert ordered(tuple(r)[:8] for r in rows) == ordered(plain_rows(docs))
    for r in rows:
        assert r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "")
    assert sum(r["count"] for r in pairs.collect()) == sum(r["n_links"] for r in rows)


def test_empty_table(spark):
    from textloom.llm.align import align_tokenizers

    found, pairs = align_tokenizers(spark.createDataFrame([], "doc_id long, text string"))
    assert found.collect() == [] and pairs.collect() == []
    found, pairs = align_tokenizers(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), keep_groups=False)
    assert ordered(tuple(r) for r in found.collect()) == [(1, 0, 0, 0, 0, 0, 0, "", None), (2, 0, 0, 0, 0, 0, 0, "", None)] and pairs.collect() == []


def test_piece_ids_are_the_librarys():
    import pyarrow as pa

    from textloom.llm.align import PieceEncoder

    own = PieceEncoder()
    texts = [t for _, t in odd_docs() if t and "▁" not in t]
    ids, bounds = own.encode(pa.array([" " + t for t in texts]))
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == own.model.encode(t), t
