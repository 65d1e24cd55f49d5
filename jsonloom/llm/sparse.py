"""Dedup by sparse suffix arrays: passages of at least 50 words that repeat from a document with a smaller id.

1. Of each window of 50 words the run of ten with the least hash is its minimiser, so equal windows have it at the same place.
   Only suffixes that start at minimisers are kept, and of them those whose minimiser another document has (see anchors).
2. A kept suffix is a row: the words behind its place and the words before it, as far as windows with this minimiser reach.
   Rows are sorted by content over ranges (Spark samples the bounds; the document breaks ties, so that copies of one passage
   can lie in several ranges).
3. Neighbours are compared inside each range. Going down the sorted suffixes, a stack finds for each the nearest suffixes of
   smaller documents on both sides, which share the most words to the right with it of all smaller documents. With these two
   the match is extended to the left, word by word, and gives its windows their source. All comparisons are of words.
4. What neighbours can't settle are windows that a smaller document may have by the words to the right, but other words to the
   left than both neighbours, and what may have its match in the next range. These windows alone are asked for by the
   SHA-256 of their words, of the suffixes with the same minimiser.

So each window of 50 words that a smaller document has is found, and its words go. What is hot: of equal suffixes of a block of
documents (4 MB) one is sorted, the others have its document as their source.

Words are runs without ASCII white space, unchanged. Defined results: a null or empty text has no words; a document under 50
words keeps them all; of equal documents the one with the smallest id keeps its words; rows with equal ids are not compared
with each other; a row with a null id keeps its words and is no source; an empty table gives no rows; other columns than the
id and the text are not read, so their names can't clash. A text must fit in one task's memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jsonloom.llm.anchors import anchors_of, changes, chosen, cut_out, repeated_anchors
from jsonloom.llm.common import PLAIN, Words, blocks, id_text, texts, written

WINDOW, ANCHOR = 50, 10
#: Minimisers that may be broadcast, 8 bytes each; more are joined.
BROADCAST_HASHES = 2_000_000
#: A suffix: the minimiser's hash, the words from its place on and before it, document and place; windows reach from `most` to
#: `least` words before the place. With a source, another document of its block has the same words.
SUFFIX = "hash long, right binary, left binary, doc long, key long, at int, least int, most int, src long, src_at int"
#: Windows of a document that start `least` to `most` words before a place: with their source, or (null) to be asked for.
MATCH = "hash long, doc long, key long, at int, least int, most int, src long, src_at int, context binary, before int"


def suffixes(docs: DataFrame, words: Words, window: int, anchor: int) -> DataFrame:
    """SUFFIX rows of docs (doc_id, key, text, anchors)."""

    def cut(batches):
        for rows in blocks(batches):
            hashes, counts, start, end, data = words.spaced(texts(rows))
            first, doc, least, place = anchors_of(words, hashes, counts, window, anchor)
            wanted = chosen(least, doc, rows.column("anchors"))
            first, doc, least, place = first[wanted], doc[wanted], least[wanted], place[wanted]
            new = np.flatnonzero(changes(place, doc))
            last = np.r_[new[1:], len(place)] - 1
            ids, keys, firsts = rows.column("doc_id").to_numpy(), rows.column("key").to_numpy(), np.cumsum(counts) - counts
            made = {f.split()[0]: [] for f in SUFFIX.split(", ")}
            known: dict[tuple[bytes, bytes], tuple[int, int]] = {}
            for i in (np.argsort(ids[doc[new]], kind="stable") if len(new) else new).tolist():
                low, high, p, d, h = int(first[new[i]]), int(first[last[i]]), int(place[new[i]]), int(doc[new[i]]), int(least[new[i]].view(np.int64))
                right, left = data[start[p] : end[high + window - 1]], data[start[low] : end[p - 1]] if p > low else b""
                own, at = int(ids[d]), p - int(firsts[d])
                src, src_at = known.setdefault((right, left), (own, at))
                mine = (h, right, left) if src == own else (h, None, None)
                row = (*mine, own, int(keys[d]), at, p - high, p - low, *((None, None) if src == own else (src, src_at)))
                for x, y in zip(made.values(), row, strict=True):
                    x.append(y)
            yield pa.RecordBatch.from_pydict(made, _schema(SUFFIX))

    return docs.mapInArrow(cut, SUFFIX)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in ddl.split(", ")])


def common(a: bytes, b: bytes) -> int:
    """How many words two texts of words and single spaces have in common at their start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    whole = low > 0 and (low == len(a) or a[low] == 0x20) and (low == len(b) or b[low] == 0x20)
    return a.count(b" ", 0, low) + whole


def common_end(a: bytes, b: bytes) -> int:
    """How many words they have in common at their end."""
    low, high, m, n = 0, min(len(a), len(b)), len(a), len(b)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[m - middle : m - low] == b[n - middle : n - low] else (low, middle - 1)
    whole = low > 0 and (low == m or a[m - low - 1] == 0x20) and (low == n or b[n - low - 1] == 0x20)
    return a.count(b" ", m - low) + whole


class Suffix:
    """A sorted suffix while its neighbours are looked for: the nearest of smaller documents and the words shared with them, and
    the words shared with the range's first and last suffix, behind which others may lie."""

    __slots__ = ("at", "before", "beyond", "doc", "gap", "hash", "key", "least", "left", "most", "partners", "right")

    def __init__(self, hash_, right, left, doc, key, at, least, most):
        self.hash, self.right, self.left, self.doc, self.key, self.at, self.least, self.most = hash_, right, left, doc, key, at, least, most
        self.before, self.beyond, self.gap, self.partners = None, 0, 0, []

    def rows(self, window: int):
        """MATCH rows of this suffix."""
        settled, bound = set(), self.beyond
        for other, shared in self.partners:
            bound = max(bound, shared)
            if shared + self.most < window:
                continue
            low, high = max(self.least, window - shared), min(self.most, common_end(self.left, other.left))
            if mine := {o for o in range(low, high + 1) if o not in settled}:
                settled |= mine
                for a, b in _ranges(mine):
                    yield self.hash, self.doc, self.key, self.at, a, b, other.doc, other.at, None, None
        for a, b in _ranges({o for o in range(max(self.least, window - bound), self.most + 1) if o not in settled}):
            yield self.hash, self.doc, self.key, self.at, a, b, None, None, self.left + b" " * bool(self.left) + self.right, self.most


def _ranges(numbers: set[int]):
    """(first, last) of each run of consecutive numbers."""
    first = None
    for x in sorted(numbers):
        if first is not None and x != last + 1:
            yield first, last
            first = None
        first, last = (x if first is None else first), x
    if first is not None:
        yield first, last


def neighbours(rows, window: int):
    """The suffixes of one sorted range, each once, when no later one can be its neighbour. `gap` is what a suffix on the stack
    shares with the next one there; documents on the stack grow from bottom to top."""
    stack: list[Suffix] = []
    previous, first, opened = None, True, 0
    for x in rows:
        shared = common(previous.right, x.right) if previous else 0
        if not shared and previous:
            # nothing to the left of here shares a word with what comes
            yield from stack
            stack.clear()
        first = first and (previous is None or shared > 0)
        opened = (x.right.count(b" ") + 1 if previous is None else min(opened, shared)) if first else 0
        x.beyond, cut = opened, shared
        while stack and stack[-1].doc > x.doc:
            done = stack.pop()
            done.partners.append((x, cut))
            yield done
            if stack:
                cut = min(cut, stack[-1].gap)
        if stack:
            top = stack[-1]
            if top.doc < x.doc:
                x.partners.append((top, cut))
            elif top.before:
                x.partners.append((top.before[0], min(cut, top.before[1])))
            top.gap = cut
        x.before = x.partners[0] if x.partners else None
        stack.append(x)
        previous = x
    cut = previous.right.count(b" ") + 1 if previous else 0
    for x in reversed(stack):
        # the range ends; what stands behind it shares no more with x than the last one here
        if x is not previous:
            cut = min(cut, x.gap)
        x.beyond = max(x.beyond, cut)
        yield x


def matches(docs: DataFrame, words: Words = PLAIN, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Of docs (doc_id, key, text): doc_id, key, start, length, source, source_start of passages that a smaller document has too.
    Passages may overlap; each window of `window` words that a smaller document has is inside one."""
    some = docs.where("doc_id is not null")
    anchors = written(repeated_anchors(docs, words, window, anchor), "anchors")
    table = written(suffixes(some.join(anchors, "doc_id").select("doc_id", "key", "text", "anchors"), words, window, anchor), "suffixes", done=(anchors,))
    names = ["hash", "right", "left", "doc", "key", "at", "least", "most"]

    def compare(batches):
        def each():
            for batch in batches:
                yield from map(Suffix, *(batch.column(c).to_pylist() for c in names))

        held = []
        for suffix in neighbours(each(), window):
            held += suffix.rows(window)
            if len(held) >= 20_000:
                yield pa.RecordBatch.from_pydict(dict(zip([f.split()[0] for f in MATCH.split(", ")], zip(*held, strict=True), strict=True)), _schema(MATCH))
                held = []
        if held:
            yield pa.RecordBatch.from_pydict(dict(zip([f.split()[0] for f in MATCH.split(", ")], zip(*held, strict=True), strict=True)), _schema(MATCH))

    own = table.where("src is null").select(*names)
    compared = written(own.repartitionByRange("right", "left", "doc").sortWithinPartitions("right", "left", "doc").mapInArrow(compare, MATCH), "matches")

    def windows(batches):
        for batch in batches:
            made = []
            for doc, key, at, least, most, context, before in zip(*(batch.column(c).to_pylist() for c in ("doc", "key", "at", "least", "most", "context", "before")), strict=True):
                cut = context.split(b" ")
                made += [(hashlib.sha256(b" ".join(cut[before - o : before - o + window])).digest(), doc, key, at, o) for o in range(least, most + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["sha", "doc", "key", "at", "o"])

    digests_ = "sha binary, doc long, key long, at int, o int"
    asked = compared.where("src is null")
    hashes = asked.select("hash").distinct()
    hashes = F.broadcast(hashes) if hashes.count() <= BROADCAST_HASHES else hashes
    context = F.concat("left", F.when(F.octet_length("left") > 0, F.lit(b" ")).otherwise(F.lit(b"")), "right")
    there = own.join(hashes, "hash", "left_semi").select("doc", "key", "at", "least", "most", context.alias("context"), F.col("most").alias("before")).mapInArrow(windows, digests_)
    least = there.groupBy("sha").agg(F.min("doc").alias("src"), F.min_by(F.col("at") - F.col("o"), "doc").alias("src_start"))
    asking = asked.select("doc", "key", "at", "least", "most", "context", "before").mapInArrow(windows, digests_)
    answered = asking.join(least, "sha").where("src < doc").select("doc", "key", (F.col("at") - F.col("o")).alias("start"), F.lit(window).alias("length"), "src", "src_start")
    named = lambda df: df.select("doc", "key", (F.col("at") - F.col("most")).alias("start"), (F.col("most") - F.col("least") + window).alias("length"), "src", (F.col("src_at") - F.col("most")).alias("src_start"))
    return named(compared.where("src is not null")).unionByName(named(table.where("src is not null"))).unionByName(answered).withColumnsRenamed({"doc": "doc_id", "src": "source", "src_start": "source_start"})


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, words: Words = PLAIN) -> DataFrame:
    """doc_id, n_words, removed (runs of words) and kept (the other words, joined by one space) of each row."""
    docs = id_text(doc_id, text, docs).withColumn("key", F.xxhash64("text"))
    found = matches(docs, words, window, anchor).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "length")).alias("removed"))
    return cut_out(docs, written(found, "spans"), words)


def digests(documents: DataFrame) -> DataFrame:
    found = deduplicated(documents)
    return found.select("doc_id", "n_words", F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["length"]).alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), f AS (SELECT g, min(doc_id) AS f FROM p GROUP BY g
), r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM p JOIN f USING (g) WHERE f < doc_id
), e AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d
), k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY e.j) AS kept FROM e ANTI JOIN r ON e.doc_id = r.doc_id AND e.j = r.j GROUP BY doc_id
), n AS (SELECT doc_id, count(*) AS n_removed FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
