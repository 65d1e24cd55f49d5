import random
import re

from jsonloom.llm import decontaminate

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORDS.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def brute(docs, items, window=10):
    out = []
    for i, text in docs:
        words, hit, found = split(text), set(), set()
        for item, t in items:
            w = split(t)
            k = min(window, len(w))
            windows = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
            at = [j for j in range(len(words) - k + 1) if w and tuple(words[j : j + k]) in windows]
            if at:
                found.add(item)
                hit.update(j + x for j in at for x in range(k))
        runs = []
        for j in sorted(hit):
            if runs and runs[-1][0] + runs[-1][1] == j:
                runs[-1][1] += 1
            else:
                runs.append([j, 1])
        out.append((i, len(words), [tuple(r) for r in runs], sorted(found)))
    return sorted(out, key=repr)


def items_of(spark, odd):
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    long_ = texts[10].split()
    rows = [(1, " ".join(long_[5:40])), (2, " ".join(long_[20:33])), (3, "one two"), (4, "One, TWO! three"), (5, None), (6, "..."), (1, " ".join(long_[5:40])), (7, " ".join(long_[100:110])), (8, "absent words here"), (9, " ".join(long_[20:29])), (10, " ".join(long_[20:25]))]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def shown(df):
    return sorted([(r.doc_id, r.n_words, [(h.start, h.length) for h in r.hits or []], r["items"]) for r in df.collect()], key=repr)


def test_matches(spark, odd, monkeypatch):
    rows, items = items_of(spark, odd)
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute(docs, rows)
    assert shown(decontaminate.matches(odd, items)) == want
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 150)  # several blocks of items
    assert shown(decontaminate.matches(odd, items)) == want
    kept = decontaminate.decontaminated(odd, items)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None) == sorted((w[0], t) for w, (_, t) in zip(sorted(want, key=lambda x: repr(x[0])), sorted(docs, key=lambda x: repr(x[0])), strict=True) if not w[3] and w[0] is not None)


def test_longest(spark, odd):
    rows, items = items_of(spark, odd)
    docs = [(r.doc_id, split(r.text)) for r in odd.where("doc_id is not null").collect()]
    found = {(r.item_id, r.item_start): r.length for r in decontaminate.longest_matches(odd.where("doc_id is not null"), items).collect()}
    for item, text in rows[:4]:
        words = split(text)
        for s in range(len(words)):
            best = 0
            for _, d in docs:
                for j in range(len(d)):
                    n = 0
                    while s + n < len(words) and j + n < len(d) and d[j + n] == words[s + n]:
                        n += 1
                    best = max(best, n)
            assert found.get((item, s), 0) == best


def test_empty(spark, odd, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(none, items_of(spark, odd)[1]).count() == 0
    assert all(not r["items"] for r in decontaminate.matches(odd, empty).collect())
    assert decontaminate.decontaminated(odd, empty).count() == odd.count()


def test_cut_off_copies():
    """Copies of an item that are cut off, or edited, after a few words: some suffixes have as many item words as the first keys hold."""
    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randrange(1500)}" for _ in range(60))) for i in range(60)]
    docs = [" ".join(items[0][1].split()[:10]), " ".join(items[0][1].split()[:5]) + " unknown"]
    for _ in range(600):
        parts = []
        for _ in range(rng.randint(1, 6)):
            words = items[rng.randrange(12)][1].split()
            at = rng.randrange(8)
            parts += [*words[at : at + rng.choice([3, 4, 5, 6, 7, 8, 9, 9, 10, 14])], *rng.choice([[], ["unknown"], ["unknown", "w3"]])]
        docs.append(" ".join(parts))
    known = decontaminate.Items([(i, t.encode()) for i, t in items], 10)
    assert len(known.vocabulary) > 1000
    for of in (docs, docs[:2], docs[::-1]):
        shard = decontaminate.Shard([split(t) for t in of], known)
        order = [tuple(shard.numbers[p : p + known.depth].tolist()) for p in shard.array.tolist()]
        cut = [o[: o.index(0)] if 0 in o else o for o in order]
        assert cut == sorted(cut)
        mask, found = shard.hits()
        got = [(d, int(n), [tuple(s) for s in decontaminate.spans(mask[a : a + n]).tolist()], sorted(set(f))) for d, (a, n, f) in enumerate(zip(shard.starts, shard.sizes, found, strict=True))]
        assert sorted(got, key=repr) == brute(list(enumerate(of)), items)


def test_many_passes(spark, monkeypatch):
    """Items in many blocks give what one block gives."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 300}" for j in range(60))) for i in range(30)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(f"w{(i * 13 + j) % 300}" for j in range(14))) for i in range(40)], "item_id long, text string")
    whole = sorted(map(repr, decontaminate.matches(docs, items).collect()))
    kept = sorted(map(repr, decontaminate.decontaminated(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 300)
    monkeypatch.setattr(decontaminate, "PASSES", 2)
    assert sorted(map(repr, decontaminate.matches(docs, items).collect())) == whole
    assert sorted(map(repr, decontaminate.decontaminated(docs, items).collect())) == kept
