"""Anchors: a cheap filter for what can repeat, shared by the operators on repeated passages.

A window is `window` consecutive words of one document. Of its runs of `anchor` words, the one with the least hash is its anchor
(a minimiser): equal windows have equal anchors, and about two anchors come in each `window - anchor + 1` words. A window whose
anchor only one document has can't repeat in another.

What is hot: a task puts equal anchors of a block of documents together. One row goes for the block to where the anchor is
dealt; where the block has several documents with it, it is known to repeat, and the rows that tell them so are dealt by
document too. So an anchor that a third of all documents hold is one small row for each block in the task that has it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jsonloom.llm.common import Words, blocks, mixed, sliding_min, texts, window_hashes, window_starts


#: Words of a block that can be told apart by their places.
PLACES = np.uint64((1 << 28) - 1)


def anchors_of(words: Words, hashes: np.ndarray, counts: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of a block: where they start, their document's number in the block, their anchor's hash and its place. Of
    the anchor's hash the upper bits are compared; of equal ones the leftmost counts."""
    start, number = window_starts(counts, window)
    if not len(start):
        return start, np.empty(0, np.int64), np.empty(0, np.uint64), start
    all_ = window_hashes(hashes, anchor)
    place = sliding_min((all_ & ~PLACES) | (np.arange(len(all_), dtype=np.uint64) & PLACES), window - anchor + 1)[start]
    place = (place & PLACES).astype(np.int64) | (start & ~np.int64(PLACES))
    return start, np.repeat(np.arange(len(counts)), number), all_[place] & words.mask, place


def salts(docs: np.ndarray) -> np.ndarray:
    """What rows are dealt by besides their hash if they are not the one of their block; never 0."""
    return (mixed(docs.astype(np.uint64)) | np.uint64(1)).view(np.int64)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns has another value than the row before; the first row is one."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def first_of(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of each distinct (hash, document): their order, whether each is the first of its hash, and that first row's place."""
    order = np.lexsort((docs, hashes))
    order = order[changes(hashes[order], docs[order])]
    first = changes(hashes[order])
    return order, first, np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))


def repeated_anchors(docs: DataFrame, words: Words, window: int, anchor: int) -> DataFrame:
    """(doc_id, anchors): for each document, its anchors that another document has too."""

    def deal(batches):
        for rows in blocks(batches):
            hashes, counts = words.of(texts(rows))
            _, doc, least, _ = anchors_of(words, hashes, counts, window, anchor)
            new = changes(least, doc)
            least, ids = least[new], rows.column("doc_id").to_numpy()[doc[new]]
            order, first, place = first_of(least, ids)
            least, ids = least[order], ids[order]
            several = np.bincount(place, minlength=len(order))[place] > 1
            told = np.flatnonzero(several)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.r_[least[first], least[told]].view(np.int64)), pa.array(np.r_[np.zeros(int(first.sum()), np.int64), salts(ids[told])]), pa.array(np.r_[ids[first], ids[told]]),
            ], names=["hash", "salt", "doc"])

    dealt = docs.where("doc_id is not null").mapInArrow(deal, "hash long, salt long, doc long").where("hash is not null and salt is not null").repartition("hash", "salt")
    again = dealt.groupBy("hash", "salt").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("salt <> 0 or low < high").select("hash", "salt")
    told = dealt.join(again, ["hash", "salt"])  # an inner join, as a semi-join would be planned before the exchange
    return told.groupBy("doc").agg(F.collect_list("hash").alias("anchors")).withColumnRenamed("doc", "doc_id")


def chosen(hashes: np.ndarray, doc: np.ndarray, own: pa.ChunkedArray) -> np.ndarray:
    """Which of the hashes, in order of their documents, are in their own document's list."""
    out, lists = np.zeros(len(hashes), bool), own.to_numpy()
    edges = np.searchsorted(doc, np.arange(len(lists) + 1))
    for low, high, mine in zip(edges.tolist(), edges[1:].tolist(), lists, strict=False):
        if mine is not None and high > low:
            out[low:high] = np.isin(hashes[low:high], mine.view(np.uint64))
    return out


def runs(mask: np.ndarray) -> np.ndarray:
    """[start, length] of each run of True."""
    edges = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return np.stack([edges[::2], edges[1::2] - edges[::2]], 1)


def cut_out(docs: DataFrame, removed: DataFrame, words: Words) -> DataFrame:
    """docs (doc_id, key, text) as doc_id, n_words, removed (runs of words), kept (the other words, joined by one space); what to
    remove comes by (doc_id, key) as `removed`, runs of words that may overlap."""

    def cut(batches):
        for rows in blocks(batches):
            _, counts, start, end, data = words.spaced(texts(rows), False)
            firsts, gone, kept = (np.cumsum(counts) - counts).tolist(), [], []
            for first, n, own in zip(firsts, counts.tolist(), rows.column("removed").to_pylist(), strict=True):
                mask = np.zeros(n, bool)
                for x in own or ():
                    mask[x["start"] : x["start"] + x["length"]] = True
                gone.append([{"start": a, "length": b} for a, b in runs(mask).tolist()])
                kept.append(b" ".join([data[start[first + a] : end[first + a + b - 1]] for a, b in runs(~mask).tolist()]))
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id").combine_chunks(), pa.array(counts), pa.array(gone, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), pa.array(kept, pa.binary()).cast(pa.string()),
            ], names=["doc_id", "n_words", "removed", "kept"])

    once = removed.groupBy("doc_id", "key").agg(F.first("removed").alias("removed"))
    return docs.join(once, ["doc_id", "key"], "left").select("doc_id", "text", "removed").mapInArrow(cut, "doc_id long, n_words long, removed array<struct<start:int,length:int>>, kept string")
