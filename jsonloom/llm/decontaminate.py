"""Benchmark decontamination: suffix arrays over shards of the training texts, searched for every test suffix.

Each task makes suffix arrays of its own documents, some MB of text at a time (a shard). All suffixes of all test items are
found in them by binary search, which gives their longest verbatim matches and where these are. A document that holds a
window of an item (`window` consecutive words; all words of a shorter item) is affected, and decontaminated() removes it.
Documents are never shuffled. The items are broadcast in blocks of at most ITEM_BYTES of text, one pass for each block, and at
most PASSES blocks at a time.

Words: see WORDS; ASCII letters are lower-cased. Defined results: a null or empty text has no words, is never affected and
is kept; an item without words matches nothing; repeated rows, of documents or of items, count each for itself; without
items, nothing is affected; an empty table gives no rows; other columns stay as they are, whatever their names. A document must fit in one task's memory, about 40 bytes for each word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jsonloom.llm.common import blocks, texts, written

#: A word is a run of these bytes: digits, letters, and all bytes of other than ASCII characters.
WORDS = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum())
SPACED = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in WORDS else 0x20 for b in range(256))
WINDOW = 10
ITEM_BYTES = 32 << 20
#: Passes that one job makes over the documents; then what they have found is written, and the blocks sent so far are let go.
PASSES = 4
RESULT = "doc_id long, n_words long, hits array<struct<start:int,length:int>>, items array<long>"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(SPACED).split() if text else []


class Items:
    """A block of test items as word numbers from 1, each item followed by 0."""

    def __init__(self, rows: list[tuple[int, bytes | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        of = [[number(w) for w in words(text)] for _, text in rows]
        sizes = np.array([len(x) for x in of], np.int64)
        self.numbers = np.array([x for item in of for x in [*item, 0]], np.int64)
        self.item = np.repeat(np.array([i for i, _ in rows], np.int64), sizes + 1)
        at = np.arange(len(self.numbers)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
        self.left = np.repeat(sizes, sizes + 1) - at
        self.window = np.minimum(np.repeat(sizes, sizes + 1), window)
        self.offset = at
        self.suffixes = np.flatnonzero(self.left > 0)
        self.depth = int(sizes.max(initial=1))


class Shard:
    """The suffix array of a few documents; a word that no item has is 0, and so is each document's end."""

    def __init__(self, documents: list[list[bytes]], items: Items):
        self.sizes = np.array([len(x) for x in documents], np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        number = items.vocabulary.get
        self.numbers = np.zeros(int(self.sizes.sum()) + len(documents) + items.depth + 64, np.int64)
        for start, document in zip(self.starts.tolist(), documents, strict=True):
            self.numbers[start : start + len(document)] = [number(w, 0) for w in document]
        self.items, self.array = items, self._sorted(items.depth, len(items.vocabulary).bit_length())

    def _sorted(self, depth: int, bits: int) -> np.ndarray:
        """Suffixes that start with an item's word, in order of their first `depth` words (prefix doubling)."""
        numbers = self.numbers
        n, span = len(numbers) - depth - 64, max(1, min(63 // max(bits, 1), 63))
        key, alive = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(span):
            alive &= numbers[j : j + n] > 0
            key = (key << bits) | np.where(alive, numbers[j : j + n], 0)
        end = np.where(numbers == 0, np.arange(len(numbers)), len(numbers))
        end = np.minimum.accumulate(end[::-1])[::-1]
        array = np.flatnonzero(numbers[:n])
        key = key[array]
        order = np.argsort(key)
        array, key = array[order], key[order]
        rank = np.zeros(len(numbers) + depth, np.int64)
        slots = np.arange(len(array))
        while len(slots):
            first = np.r_[True, key[1:] != key[:-1]]
            head = np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))
            at = array[slots]
            rank[at] = slots[head] + 1
            tied = ~(first & np.r_[first[1:], True]) & (end[at] - at >= span)  # of exactly `span` words: comes first
            slots = slots[tied]
            if span >= depth or not len(slots):
                break
            at = array[slots]
            key = rank[at] * (len(rank) + 1) + rank[at + span]
            order = np.argsort(key)
            array[slots], key = at[order], key[order]
            span *= 2
        return array

    def search(self, at: np.ndarray, length: np.ndarray, after: bool = False) -> np.ndarray:
        """For each suffix of the items, cut to a length: where it, or what comes after it, stands in the array."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.array), np.int64)
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) >> 1
            less = self._less(self.array[middle], at[open_], length[open_], after)
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)
        return low

    def _less(self, text: np.ndarray, at: np.ndarray, length: np.ndarray, equal: bool) -> np.ndarray:
        less = np.full(len(at), equal)
        rest, j = np.arange(len(at)), 0
        while len(rest):
            a, b = self.numbers[text[rest] + j], self.items.numbers[at[rest] + j]
            less[rest[a < b]], less[rest[a > b]] = True, False
            j += 1
            rest = rest[(a == b) & (length[rest] > j)]
        return less

    def common(self, slot: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Length of the common prefix of array slots and item suffixes; 0 for a slot outside."""
        out = np.zeros(len(at), np.int64)
        rest, j = np.flatnonzero((slot >= 0) & (slot < len(self.array))), 0
        while len(rest):
            rest = rest[(self.numbers[self.array[slot[rest]] + j] == self.items.numbers[at[rest] + j]) & (self.items.left[at[rest]] > j)]
            j += 1
            out[rest] = j
        return out

    def longest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each item suffix, its longest match here: its position, the match's length and place (-1: none)."""
        at = self.items.suffixes
        slot = self.search(at, self.items.left[at])
        before, behind = self.common(slot - 1, at), self.common(slot, at)
        best = np.where(before > behind, slot - 1, slot)
        length = np.maximum(before, behind)
        place = np.where(length > 0, self.array[np.minimum(best, len(self.array) - 1)], -1) if len(self.array) else np.full(len(at), -1)
        return at, length, place

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, "right") - 1

    def hits(self) -> tuple[np.ndarray, list[list[int]]]:
        """Which words of the shard are hit, and the items that hit each document."""
        at, length, _ = self.longest()
        items, covered = self.items, np.zeros(len(self.numbers) + 1, np.int64)
        at = at[(items.left[at] >= items.window[at]) & (length >= items.window[at])]
        low, high = self.search(at, items.window[at]), self.search(at, items.window[at], True)
        found: list[list[int]] = [[] for _ in self.sizes]
        # equal windows start at one slot and count once; a short item can start there too
        _, first, same = np.unique(low * (self.items.depth + 1) + items.window[at], return_index=True, return_inverse=True)
        size, window = (high - low)[first], items.window[at[first]]
        occurrence = np.repeat(np.arange(len(first)), size)
        slot = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[first], size)
        place = self.array[slot]
        np.add.at(covered, place, 1)
        np.add.at(covered, place + window[occurrence], -1)
        by_window: list[set[int]] = [set() for _ in first]
        for w, item in zip(same.tolist(), items.item[at].tolist(), strict=True):
            by_window[w].add(item)
        pairs = np.unique(self.document(place) * max(len(first), 1) + occurrence)
        for d, w in zip((pairs // max(len(first), 1)).tolist(), (pairs % max(len(first), 1)).tolist(), strict=True):
            found[d].extend(by_window[w])
        return np.cumsum(covered[:-1]) > 0, found


def spans(mask: np.ndarray) -> np.ndarray:
    """[start, length] of each run of True."""
    edges = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return np.stack([edges[::2], edges[1::2] - edges[::2]], 1) if len(edges) else np.empty((0, 2), np.int64)


def item_blocks(items: DataFrame, item_id: str, text: str, window: int) -> Iterator[Items]:
    """The items, by blocks whose size is checked before the driver takes them."""
    rows = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16), F.lit(0))).first()[0]
    parts = max(1, math.ceil(1.5 * size / ITEM_BYTES)) if size > ITEM_BYTES else 1
    for part in range(parts):
        block = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield Items([(r.item_id, bytes(r.text) if r.text is not None else None) for r in block.collect()], window)


def _let_go(found: DataFrame, sent: list) -> DataFrame:
    """found, written once PASSES blocks of items are out; these are given back."""
    if len(sent) < PASSES:
        return found
    found = written(found, "passes")
    for block in sent:
        block.unpersist()
    sent.clear()
    return found


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """For each document (a row each, RESULT): its words, the runs of them that are hit, and the items that hit it, sorted."""
    found = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<struct<start:int,length:int>>").alias("hits"), F.array().cast("array<long>").alias("items"))
    out: list = []
    for block in item_blocks(items, item_id, item_text, window):
        found = _let_go(found, out)
        sent = docs.sparkSession.sparkContext.broadcast(block)
        out.append(sent)

        def search(batches, sent=sent):
            for rows in blocks(batches):
                documents = [words(t) for t in texts(rows)]
                shard = Shard(documents, sent.value)
                mask, now = shard.hits()
                for start, (d, before) in zip(shard.starts.tolist(), enumerate(rows.column("hits").to_pylist()), strict=True):
                    for span in before or ():
                        mask[start + span["start"] : start + span["start"] + span["length"]] = True
                old = rows.column("items").to_pylist()
                hits = [spans(mask[s : s + n]).tolist() if now[d] or old[d] else [] for d, (s, n) in enumerate(zip(shard.starts.tolist(), shard.sizes.tolist(), strict=True))]
                yield pa.RecordBatch.from_arrays([
                    rows.column("doc_id").combine_chunks(), rows.column("text").combine_chunks(), pa.array(shard.sizes),
                    pa.array([[{"start": a, "length": b} for a, b in h] for h in hits], pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))),
                    pa.array([sorted({*a, *b}) for a, b in zip(old, now, strict=True)], pa.list_(pa.int64())),
                ], names=["doc_id", "text", "n_words", "hits", "items"])

        found = found.mapInArrow(search, f"doc_id long, text string, {RESULT.split(', ', 1)[1]}")
    return found.drop("text")


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs that no item hits, with all their columns."""
    out: list = []
    for block in item_blocks(items, item_id, item_text, window):
        docs = _let_go(docs, out)
        sent = docs.sparkSession.sparkContext.broadcast(block)
        out.append(sent)

        def keep(batches, sent=sent):
            for rows in blocks(batches, text):
                _, found = Shard([words(t) for t in texts(rows, text)], sent.value).hits()
                yield from rows.filter(pa.array([not x for x in found], pa.bool_())).to_batches()

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def longest_matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each suffix of each item that matches at all: item_id, item_start, the length of its longest match in any
    document, and the smallest (doc_id, doc_start) of those that its shards found."""
    schema, out = "item_id long, item_start int, length int, doc_id long, doc_start int", None
    for block in item_blocks(items, item_id, item_text, WINDOW):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches, sent=sent):
            for rows in blocks(batches):
                shard, ids = Shard([words(t) for t in texts(rows)], sent.value), rows.column("doc_id").to_numpy()
                at, length, place = shard.longest()
                at, length, place = at[length > 0], length[length > 0], place[length > 0]
                of = shard.document(place)
                yield pa.RecordBatch.from_arrays([pa.array(sent.value.item[at]), pa.array(sent.value.offset[at], pa.int32()), pa.array(length, pa.int32()), pa.array(ids[of]), pa.array(place - shard.starts[of], pa.int32())], names=["item_id", "item_start", "length", "doc_id", "doc_start"])

        part = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("item_id", "item_start").agg(F.max(F.struct("length", (-F.col("doc_id")).alias("d"), (-F.col("doc_start")).alias("s"))).alias("m"))
    return best.select("item_id", "item_start", F.col("m.length").alias("length"), (-F.col("m.d")).alias("doc_id"), (-F.col("m.s")).alias("doc_start"))


# ---- query ----


def digests(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = matches(documents, benchmark)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["length"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), n AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0
), q AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM n)
), s AS (SELECT DISTINCT k FROM n
), p AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, s WHERE len(w) >= k)
), m AS (SELECT DISTINCT doc_id, i, p.k, item_id FROM p JOIN q ON p.k = q.k AND p.g = q.g
), h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id
), t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS x FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
