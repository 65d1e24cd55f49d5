import zlib

import numpy as np
from tokenizers import Tokenizer

from test_repeats import MORSE, THUE

from jsonloom.llm import packing
from jsonloom.llm.common import WHITE, Words


def check(rows, found, limit):
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want, places = [], {}
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, p, s, len(ids[s : s + limit]), zlib.crc32(np.array(ids[s : s + limit], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), limit))]
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in found), key=repr) == sorted(want, key=repr)
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
    return len(places), -(-sum(w[3] for w in want) // limit)


def test_packing(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for limit in (2048, 64):
        used, least = check(rows, packing.packed(odd, limit=limit).collect(), limit)
        assert used <= least * 1.1 + 1
    assert packing.packed(none).count() == 0


def test_odd_texts(spark):
    texts = ["a <|endoftext|> B", "<|ENDOFTEXT|>x", "don't. I'LL, won't!", "x\x01y \x01", "a.,b. 1.5, …. é. É, ﬁ.", "\x1c\x85\u2028z", "K. K Σ Σς", "end."]
    rows = list(enumerate(texts))
    check(rows, packing.packed(spark.createDataFrame(rows, "doc_id long, text string")).collect(), 2048)
    check(rows[3:4], packing.packed(spark.createDataFrame(rows[3:4], "doc_id long, text string")).collect(), 2048)


def test_sequences(odd):
    found = packing.sequences(odd, limit=256).collect()
    assert sum(len(r.ids) for r in found) == sum(r.length for r in packing.packed(odd, limit=256).collect())
    assert max(len(r.ids) for r in found) <= 256


def test_plan():
    rng = np.random.default_rng(3)
    for n in (1, 10, 1000, 100000):
        lengths = np.minimum(100, rng.geometric(0.05, n))
        counts = {int(a): int(c) for a, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
        plan = packing.Plan(counts, 100)
        used = {}
        for length, first, _, copies, _ in plan.arrays().tolist():
            assert copies > 0 and first == used.setdefault(length, 0) or first > 0
        assert plan.left.sum() == 0
        assert plan.sequences <= -(-int(lengths.sum()) // 100) * 1.05 + 2
    assert packing.complement(10, np.array([0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0])) == [7, 3]
    assert packing.complement(10, np.array([0, 0, 1, 1, 0, 1, 0, 0, 0, 0, 0])) == [5, 3, 2]


def test_words_that_hash_alike(monkeypatch):
    """With hashes of ten bits most words meet another's hash; ids stay those of the tokenizer."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"word{rng.integers(3000)}" for _ in range(400)).encode() for _ in range(6)] + [THUE.encode(), MORSE.encode()]
    monkeypatch.setattr(packing, "LOWERED", Words(WHITE, True, bits=10))
    lexicon, tokenizer = packing.Lexicon(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer())
    for _ in range(2):
        ids, counts = lexicon.encode(texts)
        assert ids.tolist() == [x for t in texts for x in [*tokenizer.encode(t.decode(), add_special_tokens=False).ids, 0]]
