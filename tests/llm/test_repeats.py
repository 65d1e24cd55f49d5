import pytest

from jsonloom.llm import debruijn, sparse
from jsonloom.llm.common import WHITE, Words

#: Two words of 1,024 letters that differ at half of their places and hash alike as polynomials modulo 2**64.
THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
MORSE = THUE.translate(str.maketrans("ab", "ba"))


def brute(rows, window):
    first = {}
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in texts:
        if i is not None:
            for j in range(len(w) - window + 1):
                key = tuple(w[j : j + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in texts:
        gone = set()
        for j in range(len(w) - window + 1):
            if i is not None and first.get(tuple(w[j : j + window]), i) < i:
                gone.update(range(j, j + window))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=repr)


def shown(df):
    return sorted(((r.doc_id, r.n_words, sum(x.length for x in r.removed), r.kept) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("operator", "window", "anchor", "bits"), [(debruijn, 13, 5, 64), (debruijn, 3, 2, 64), (debruijn, 13, 5, 14), (sparse, 50, 10, 64), (sparse, 6, 2, 64), (sparse, 50, 10, 12)])
def test_against_brute_force(odd, operator, window, anchor, bits):
    # with few bits words, edges and chains collide all the time
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert shown(operator.deduplicated(odd, window=window, anchor=anchor, words=Words(WHITE, bits=bits))) == brute(rows, window)


@pytest.mark.parametrize(("operator", "window"), [(debruijn, 13), (sparse, 50)])
def test_words_that_collide_as_polynomials(spark, operator, window):
    rows = [(1, " ".join([THUE] * window)), (2, " ".join([MORSE] * window)), (3, " ".join([THUE] * window))]
    assert shown(operator.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, window)


@pytest.mark.parametrize("operator", [debruijn, sparse])
def test_passage_of_every_document_and_rings(spark, operator):
    # one passage in all, its copies cut at all places, and texts that go round
    passage = [f"p{i}" for i in range(90)]
    rows = [(i, " ".join([f"a{i}", *passage[i % 7 : 90 - i % 11], f"b{i}"])) for i in range(40)]
    rows += [(40 + i, " ".join(["x", "y", "z"] * (20 + i))) for i in range(5)] + [(50, "same " * 80), (51, "same " * 90)]
    window = operator.WINDOW
    assert shown(operator.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))) == brute(rows, window)


def test_empty(none):
    assert debruijn.deduplicated(none).count() == 0
    assert sparse.digests(none.select("doc_id", "text")).count() == 0


def test_unitigs(spark):
    """Passages without a branch are one unitig; where documents part, unitigs end."""
    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    rows = [(1, " ".join(a + b)), (2, " ".join(a + c)), (3, " ".join(["s", *a, *b])), (4, " ".join(["t", *a, *c]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    anchors = debruijn.repeated_anchors(docs, debruijn.PLAIN, 13, 5)
    table = debruijn.written(debruijn.chain_rows(docs.join(anchors, "doc_id"), debruijn.PLAIN, 13, 5), "chains")
    found = debruijn.unitigs(table).collect()
    by = {}
    for r in found:
        by.setdefault((r.unitig_src, r.unitig_at), []).append((r.before, r.n))
    for own in by.values():
        at = 0
        for before, n in sorted(own):
            assert before == at
            at += n
    assert 3 <= len(by) <= 5 and sum(r.n for r in found) >= 48 + 48 + 48
