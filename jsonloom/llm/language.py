"""Language identification in two steps: the family first, then one-versus-one linear SVMs inside the family.

Features are hashed byte trigrams of the lower-cased whole text, square-rooted and normalised. The classifier is fitted on
the driver from a bounded sample: about SAMPLE documents of each language, chosen by a hash of their text, fewer where there are
so many languages that it would be over TOTAL texts. Of more than LANGUAGES labels those with the most texts are learned.
Prediction reads each text once, where it lies; nothing is shuffled.

FAMILIES says which languages are related; a language that it doesn't name is a family of its own. The family is the one
whose linear one-versus-rest classifier is surest; inside it, each pair of languages votes by its SVM.

Defined results: `und` with score 0 for a null text or one without any letter; with no labelled rows at all, every text is
`und`; the score is the chosen family's probability times the mean probability of the winner in its pairs; of equal votes the
sum of margins decides, then the language's name. Equal texts are judged alike. Columns named as the two new ones give way to
them; an empty table gives no rows. A very long text is read whole, and must fit in one task's memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jsonloom.llm.common import blocks

BUCKETS = 1 << 12
SAMPLE = 400
LANGUAGES = 300
#: Texts of the sample in all, and of those of a language at least.
TOTAL, LEAST = 10_000, 30
#: Letters by Unicode's categories L*: no digits, fractions or Roman numerals.
LETTER = regex.compile(r"\p{L}")
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"), "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"), "uralic": ("fi", "et", "hu"), "turkic": ("tr", "az", "kk"),
}


def vector(text: str) -> np.ndarray:
    """Square roots of the trigram counts by bucket, of length 1."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    counts = np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
    out = np.sqrt(counts.astype(np.float32))
    return out / max(float(np.linalg.norm(out)), 1e-9)


def svm(rows: np.ndarray, sign: np.ndarray, cost: float = 10.0, rounds: int = 40) -> np.ndarray:
    """A linear SVM with squared hinge loss, by dual coordinate descent; the last weight is the bias. Classes count alike."""
    rows = np.hstack([rows, np.ones((len(rows), 1), np.float32)]).astype(np.float64)
    balance = np.where(sign > 0, 0.5 / max((sign > 0).mean(), 1e-9), 0.5 / max((sign < 0).mean(), 1e-9))
    diagonal, alpha, weights = 1 / (2 * cost * balance), np.zeros(len(rows)), np.zeros(rows.shape[1])
    norm, order = (rows**2).sum(1) + diagonal, np.random.default_rng(0)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(rows)):
            gradient = sign[i] * (weights @ rows[i]) - 1 + diagonal[i] * alpha[i]
            new = max(alpha[i] - gradient / norm[i], 0.0)
            if new != alpha[i]:
                weights += (new - alpha[i]) * sign[i] * rows[i]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return weights


class Model:
    """families: their languages; by_family: one-versus-rest weights; by_pair: (family, i, j, weights), positive for i."""

    def __init__(self, rows: np.ndarray, langs: list[str]):
        names = {lang: next((f for f, members in FAMILIES.items() if lang in members), lang) for lang in sorted(set(langs))}
        self.families = {f: [x for x in names if names[x] == f] for f in sorted(set(names.values()))}
        lang, family = np.array(langs, object), np.array([names[x] for x in langs], object)
        # many languages have few texts each, and get fewer rounds
        rounds = 40 if len(names) <= 40 else 8
        self.by_family = [svm(rows, np.where(family == f, 1.0, -1.0), rounds=rounds) for f in self.families] if len(self.families) > 1 else []
        self.by_pair = []
        for f, members in enumerate(self.families.values()):
            for i, a in enumerate(members):
                for j, b in list(enumerate(members))[i + 1 :]:
                    both = (lang == a) | (lang == b)
                    self.by_pair.append((f, i, j, svm(rows[both], np.where(lang[both] == a, 1.0, -1.0))))

    def predict(self, rows: np.ndarray) -> tuple[list[str], np.ndarray]:
        margin = lambda w, x: x @ w[:-1] + w[-1]
        chance = lambda m: 1 / (1 + np.exp(-4 * m))
        families = list(self.families.values())
        margins = np.stack([margin(w, rows) for w in self.by_family], 1) if self.by_family else np.zeros((len(rows), 1))
        best = margins.argmax(1)
        score = chance(margins[np.arange(len(rows)), best]) if self.by_family else np.ones(len(rows))
        out = np.empty(len(rows), object)
        for f, members in enumerate(families):
            mine = np.flatnonzero(best == f)
            votes, sums, sure = (np.zeros((len(mine), len(members))) for _ in range(3))
            for _, i, j, w in (x for x in self.by_pair if x[0] == f):
                m = margin(w, rows[mine])
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                sums[:, i] += m
                sums[:, j] -= m
                sure[:, i] += chance(m)
                sure[:, j] += chance(-m)
            at = np.array([max(range(len(members)), key=lambda k, r=r: (votes[r, k], sums[r, k], -k)) for r in range(len(mine))], np.int64)
            out[mine] = [members[k] for k in at]
            if len(members) > 1 and len(mine):
                score[mine] *= sure[np.arange(len(mine)), at] / (len(members) - 1)
        return out.tolist(), np.clip(score, 0, 1)


def fitted(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model of about `sample` texts of each language; None if no row has a language and a letter."""
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("text is not null and lang is not null")
    most = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = {r.lang: r.n for r in most.collect()}
    if not counts:
        return None
    sample = min(sample, max(LEAST, TOTAL // len(counts)))
    limit = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1 << 30, int((1 << 30) * sample / n)))])
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < limit[F.col("lang")])

    def vectors(batches):
        for batch in batches:
            for block in blocks(iter([batch])):
                kept = [(t, x) for t, x in zip(block.column("text").to_pylist(), block.column("lang").to_pylist(), strict=True) if LETTER.search(t)]
                yield pa.RecordBatch.from_arrays([pa.array([vector(t).tobytes() for t, _ in kept], pa.binary()), pa.array([x for _, x in kept], pa.string())], names=["vector", "lang"])

    # equal texts can be many; one of each is enough
    found = sorted({(bytes(r.vector), r.lang) for r in chosen.mapInArrow(vectors, "vector binary, lang string").groupBy("lang", "vector").count().collect()})
    return Model(np.stack([np.frombuffer(v, np.float32) for v, _ in found]), [x for _, x in found]) if found else None


def identified(docs: DataFrame, model: Model | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns: the language predicted from the text alone, and its score."""
    docs = docs.drop(pred, score)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def predict(batches):
        for rows in blocks(batches, text):
            langs, scores = ["und"] * len(rows), [0.0] * len(rows)
            known, vectors = [], []
            for i, t in enumerate(rows.column(text).to_pylist()):
                if sent.value is not None and t and LETTER.search(t):
                    known.append(i)
                    vectors.append(vector(t))
            for at in range(0, len(known), 512):
                for i, x, s in zip(known[at : at + 512], *sent.value.predict(np.stack(vectors[at : at + 512])), strict=True):
                    langs[i], scores[i] = x, float(s)
            yield from rows.append_column(pred, pa.array(langs, pa.string())).append_column(score, pa.array(scores, pa.float64())).combine_chunks().to_batches()

    names = docs.schema
    return docs.mapInArrow(predict, type(names)([*names.fields]).add(pred, "string").add(score, "double"))


# ---- query ----


def held_out() -> Column:
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5) == 0


def digests(documents: DataFrame) -> DataFrame:
    """The model learns from documents that are not held out; all are predicted."""
    model = fitted(documents.where(~held_out() & F.col("doc_id").isNotNull()))
    found = identified(documents.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
