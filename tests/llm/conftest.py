"""Documents with every odd case that the operators define a result for."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash long, doc long, words string, items array<int>"


def make(seed=0, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Éa,", "straße.", "日本", "x😀", "The", "the"]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared, long_ = say(60), say(3000)
    texts = [None, "", "   \n\t", "one", "one two three", "ONE two three", say(12), say(13), say(13), "12345 !!", long_, long_ + " tail", say(5000)]
    for i in range(n):
        t = say(rng.randint(1, 120))
        kind = i % 6
        if kind == 0:
            t = f"{say(9)} {shared} {say(4)}"
        elif kind == 1:
            words = shared.split()
            words[rng.randrange(60)] = "changed"
            t = " ".join(words)
        elif kind == 2 and i > 20:
            t = rng.choice([x for x in texts if x])
        elif kind == 3:
            words = long_.split()[:200]
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(200)] = "edit"
            t = " ".join(words)
        texts.append(t)
    rows = [(i, t, rng.choice(["en", "de", None]), "s", 0, i, -i, "w", [1]) for i, t in enumerate(texts)]
    return [*rows, rows[10], rows[14], (None, shared, "en", "s", 0, 0, 0, "w", None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(make(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
