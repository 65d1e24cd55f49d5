import random

import pytest

from test_repeats import MORSE, THUE

from jsonloom.llm import jaccard
from jsonloom.llm.common import WHITE, Words


def brute(rows, k, similarity):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        grams = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(grams)
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and similarity[1] * len(x & y) >= similarity[0] * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return sorted(((i, len(s), top(i) if i is not None else None) for i in sets for s in sets[i]), key=repr)


@pytest.mark.parametrize(("k", "similarity"), [(4, (85, 100)), (5, (80, 100)), (2, (60, 100))])
def test_components(odd, k, similarity):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted((tuple(r) for r in jaccard.linked(odd, k=k, similarity=similarity).collect()), key=repr)
    assert got == brute(rows, k, similarity)


def test_near_copies_of_all_degrees(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)  # buckets over several tasks
    rng, rows = random.Random(5), []
    for g in range(6):
        base = [f"g{g}x{rng.randrange(10**6)}" for _ in range(rng.choice([8, 30, 80, 200]))]
        for i in range(30):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 15))):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in jaccard.linked(docs).collect()), key=repr)
    assert got == brute(rows, 4, (85, 100))


def test_empty(none):
    assert jaccard.linked(none).count() == 0
    assert jaccard.copies(none).count() == 0


def test_stars(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (9, 1), (7, 8), (8, 8)], "a long, b long")
    assert sorted(map(tuple, jaccard.components(edges).collect())) == [(1, 1), (3, 1), (4, 1), (5, 1), (7, 7), (8, 7), (9, 1)]


def test_words_that_collide(spark):
    rows = [(1, THUE), (2, MORSE), (3, THUE.upper()), (4, f"{THUE} b c d e"), (5, f"{MORSE} b c d e")]
    got = sorted(tuple(r) for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 2, 4), (5, 2, 5)]
    # hashes of few bits: what is linked still shares its words
    few = [(i, f"word{i} of{i} text{i} number{i}") for i in range(300)] + [(300, "word7 of7 text7 number7")]
    got = dict((r.doc_id, r.component_id) for r in jaccard.linked(spark.createDataFrame(few, "doc_id long, text string"), words=Words(WHITE, True, bits=10)).collect())
    assert got == {**{i: i for i in range(300)}, 300: 7}
