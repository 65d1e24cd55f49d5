"""Best-fit packing of tokenised documents into sequences of a fixed length, by exact-complement hashing.

Each document becomes token ids and an end id. A document over the limit is cut into pieces of the limit; the last may be
shorter. How pieces combine depends on their lengths alone, so the driver plans on the histogram of lengths, which has at
most `limit` rows however large the corpus is: going down the lengths, it looks up a single length, a pair or a triple whose
sum is exactly the gap, and uses that combination as often as the counts allow; what is left is filled best fit first. The
plan, a few numbers for each use of a length, is broadcast. A piece finds its place by its length and its rank among pieces
of that length: its rank in its task, counted while tokenising, plus the counts of the tasks before. No group of pieces ever
meets in one task.

Words are tokenised once and kept: the tokenizer must treat words between ASCII white space apart and drop the white space,
as word_bpe_49k.json does.

Defined results: a null or empty text is the end id alone; repeated rows are packed each for itself; an empty table has no
pieces. Sequence numbers run from 0 but depend on how rows are dealt over tasks; lengths, ids and the number of sequences
do not. A document must fit in one task's memory, about 12 bytes a token.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jsonloom.llm.common import LOWERED, PLAIN, alike, blocks, texts, written

LIMIT = 2048
END = 0
#: Words whose ids a task keeps.
KEPT_WORDS = 150_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Lexicon:
    """Ids of words, by number; new words are encoded in batches. Number 0 stands for a document's end.

    Letter case and a full stop or comma behind a letter or digit don't matter to the tokenizer's words, so a word is looked
    up without them; the stop is a word of its own. A document with a special token's mark keeps its case."""

    BETWEEN = 1
    WORDS_AT_ONCE = 2000

    def __init__(self, path: str):
        # a task has one core, and each of the library's threads would keep memory of its own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.between = self._encoded([chr(self.BETWEEN)])
        self._empty()

    def _empty(self) -> None:
        self.hash, self.number = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.ids, self.start, self.length = np.full(1, END, np.uint32), np.zeros(1, np.int32), np.ones(1, np.int32)
        # the words themselves, by number: a word is taken for a known one only if all its bytes are the same
        self.bytes, self.low, self.high = np.full(8, 0x20, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _add(self, data: np.ndarray, shown: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Encodes words and gives them the next numbers."""
        flat, sizes = self._new(data, start, end)
        self.start = np.r_[self.start, (len(self.ids) + np.cumsum(sizes) - sizes).astype(np.int32)]
        self.length = np.r_[self.length, sizes.astype(np.int32)]
        self.ids = np.concatenate([self.ids, flat])
        width = end - start
        low = len(self.bytes) - 8 + np.cumsum(width) - width
        inner = np.arange(int(width.sum()))
        put = shown[inner + np.repeat(start - (np.cumsum(width) - width), width)]
        self.bytes = np.concatenate([self.bytes[:-8], put, np.full(8, 0x20, np.uint8)])
        self.low, self.high = np.r_[self.low, low], np.r_[self.high, low + width]

    def _encoded(self, texts_: list[str]) -> list[int]:
        return [i for x in self.tokenizer.encode_batch_fast(texts_, add_special_tokens=False) for i in x.ids]

    def _new(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts of some words, which are encoded together with a mark behind each."""
        sizes = end - start
        ends = np.cumsum(sizes + 3)
        put = np.full(int(ends[-1]), 0x20, np.uint8)
        put[ends - 2] = self.BETWEEN
        inner = np.arange(int(sizes.sum()))
        first = np.cumsum(sizes) - sizes
        put[inner + np.repeat(ends - sizes - 3 - first, sizes)] = data[inner + np.repeat(start - first, sizes)]
        borders = [0, *ends[self.WORDS_AT_ONCE - 1 : -1 : self.WORDS_AT_ONCE].tolist(), len(put)]
        if len(self.between) == 1:
            flat = np.array(self._encoded([put[a:b].tobytes().decode() for a, b in zip(borders, borders[1:], strict=False)]), np.uint32)
            at = np.flatnonzero(flat == self.between[0])
            if len(at) == len(start) == int((put == self.BETWEEN).sum()):
                return flat[flat != self.between[0]], np.diff(np.r_[-1, at]) - 1
        each = [self._encoded([data[a:b].tobytes().decode()]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        return np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64)

    def encode(self, documents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, each with END behind it, and each document's count."""
        if len(self.hash) > KEPT_WORDS:
            self._empty()
        joined = b" ".join([*documents, b" " * 8])
        data, ends = np.frombuffer(joined, np.uint8), np.cumsum([len(d) + 1 for d in documents], dtype=np.int64)
        cut = PLAIN if b"<|" in joined else LOWERED
        shown = np.frombuffer(cut.shown(joined), np.uint8)
        start, end = cut.spans(data)
        if len(start):
            stopped = np.flatnonzero(STOP[data[end - 1]] & (end - start > 1) & ALNUM[data[np.maximum(end - 2, 0)]])
            start, end = _split(start, end, stopped)
        hashes, counts = cut.hashes(shown, start, end), np.diff(np.searchsorted(start, np.r_[0, ends]))
        # the distinct words of these documents, where each first stands, and their numbers
        distinct, first, same = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hash, distinct), max(len(self.hash) - 1, 0))
        new = self.hash[at] != distinct if len(self.hash) else np.ones(len(distinct), bool)
        number = np.where(new, 0, self.number[at] if len(self.hash) else 0).astype(np.int32)
        if new.any():
            number[new] = len(self.start) + np.arange(int(new.sum()))
            self._add(data, shown, start[first[new]], end[first[new]])
            self.hash, self.number = np.concatenate([self.hash, distinct[new]]), np.concatenate([self.number, number[new]])
            order = np.argsort(self.hash)
            self.hash, self.number = self.hash[order], self.number[order]
        number = number[same]
        odd = np.flatnonzero(~alike(shown, start, end, self.bytes, self.low[number], self.high[number]))
        if len(odd):
            # other words with the hash of a known one: they get numbers of their own, for now
            own: dict[bytes, int] = {}
            place = np.array([own.setdefault(shown[start[i] : end[i]].tobytes(), len(own)) for i in odd.tolist()], np.int32)
            _, each = np.unique(place, return_index=True)
            number[odd] = len(self.start) + place
            self._add(data, shown, start[odd[each]], end[odd[each]])
        words = np.zeros(len(hashes) + len(documents), np.int32)
        words[np.arange(len(hashes)) + np.repeat(np.arange(len(documents)), counts)] = number
        sizes = self.length[words]
        total = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
        ids = self.ids[np.arange(int(total[-1])) + np.repeat(self.start[words] - total[:-1], sizes)]
        return ids, np.diff(total[np.r_[0, np.cumsum(counts + 1)]])


STOP, ALNUM = (np.isin(np.arange(256), list(x)) for x in (b".,", b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))


def _split(start: np.ndarray, end: np.ndarray, stopped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts the last byte off some words, as words of their own."""
    last = end[stopped] - 1
    own = np.arange(len(start)) + np.searchsorted(stopped, np.arange(len(start)))
    low, high = np.empty(len(start) + len(stopped), np.int64), np.empty(len(start) + len(stopped), np.int64)
    low[own], high[own] = start, end
    high[own[stopped]] = last
    low[own[stopped] + 1], high[own[stopped] + 1] = last, last + 1
    return low, high


@functools.lru_cache(maxsize=2)
def lexicon(path: str) -> Lexicon:
    return Lexicon(path)


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, the task that made it and its rank there by length; ids if asked for."""
    path = tokenizer or default_tokenizer()

    def cut(batches):
        seen, task = np.zeros(limit + 1, np.int64), TaskContext.get().partitionId()
        for rows in blocks(batches):
            ids, counts = lexicon(path).encode([t or b"" for t in texts(rows)])
            number = -(-counts // limit)
            doc = np.repeat(np.arange(len(counts)), number)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
            start = piece * limit
            length = np.minimum(counts[doc] - start, limit)
            first = (np.cumsum(counts) - counts)[doc] + start
            crc = [zlib.crc32(ids[a : a + n].astype("<u4").tobytes()) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            sorted_ = length[order]
            new = np.r_[True, sorted_[1:] != sorted_[:-1]] if len(order) else np.zeros(0, bool)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) + seen[sorted_]
            seen += np.bincount(length, minlength=limit + 1)
            made = {"doc_id": rows.column("doc_id").combine_chunks().take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()), "task": pa.array(np.full(len(doc), task), pa.int32()), "rank": pa.array(rank)}
            if with_ids:
                made["ids"] = pa.array([ids[a : a + n].astype(np.int32) for a, n in zip(first.tolist(), length.tolist(), strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(made)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids array<int>" * with_ids
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(cut, schema)


# ---- the plan ----


def complement(gap: int, left: np.ndarray) -> list[int] | None:
    """A single length, else a pair, else a triple of available lengths that fills the gap exactly; the largest first."""
    if gap > 0 and left[gap]:
        return [gap]
    if found := _pair(gap, left):
        return found
    for x in np.flatnonzero(left[: gap - 1])[::-1].tolist() if gap > 2 else ():
        if 3 * x < gap:
            break
        left[x] -= 1
        found = _pair(gap - x, left, x)
        left[x] += 1
        if found:
            return [x, *found]
    return None


def _pair(gap: int, left: np.ndarray, most: int | None = None) -> list[int] | None:
    low = max(1, gap - most) if most else 1
    half = gap // 2
    if half < low:
        return None
    small = np.arange(low, half + 1)
    fits = np.flatnonzero((left[small] > 0) & (left[gap - small] > (2 * small == gap)))
    return [gap - int(small[fits[0]]), int(small[fits[0]])] if len(fits) else None


class Plan:
    """Uses of lengths: each is for some ranks of a length, `copies` of them in a sequence from `offset` on."""

    def __init__(self, counts: dict[int, int], limit: int):
        self.limit, self.left, self.used, self.sequences = limit, np.zeros(limit + 1, np.int64), np.zeros(limit + 1, np.int64), 0
        for length, n in counts.items():
            self.left[length] = n
        self.uses: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, copies, offset
        self._use([limit])
        for length in range(limit - 1, 0, -1):
            self.left[length] -= (own := int(self.left[length] > 0))
            while own:
                found = complement(limit - length, self.left)
                self.left[length] += 1
                own = int(found is not None and self._use([length, *found]) and self.left[length] > 0)
                self.left[length] -= own
        while len(rest := np.flatnonzero(self.left)):
            chosen, gap = [int(rest[-1])], limit - int(rest[-1])
            self.left[chosen[0]] -= 1
            while gap and len(fits := np.flatnonzero(self.left[: gap + 1])):
                best = int(fits[-1])
                copies = min(int(self.left[best]), gap // best)
                chosen += [best] * copies
                self.left[best] -= copies
                gap -= copies * best
            for length in chosen:
                self.left[length] += 1
            self._use(chosen)

    def _use(self, lengths: list[int]) -> bool:
        """Takes this combination as often as the counts allow."""
        need = Counter(lengths)
        times = min(int(self.left[x]) // n for x, n in need.items())
        if times:
            offset = 0
            for length, copies in need.items():
                self.uses.append((length, int(self.used[length]), self.sequences, copies, offset))
                self.used[length] += times * copies
                self.left[length] -= times * copies
                offset += copies * length
            self.sequences += times
        return bool(times)

    def arrays(self) -> np.ndarray:
        return np.array(sorted(self.uses), np.int64).reshape(-1, 5)


def placed(made: DataFrame, limit: int = LIMIT) -> DataFrame:
    """pieces() with sequence_id and offset instead of task and rank; `made` is read twice and must be a written table."""
    tallies = made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    uses = made.sparkSession.sparkContext.broadcast(Plan(counts, limit).arrays())
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = tallies.select(F.col("length").alias("l"), F.col("task").alias("t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = made.join(earlier, (F.col("length") == F.col("l")) & (F.col("task") == F.col("t"))).withColumn("rank", F.col("rank") + F.col("earlier")).drop("l", "t", "task", "earlier")

    def place(batches):
        table = uses.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            # by length, then rank: lengths are looked up first, so that the numbers stay within 64 bits
            low, high = np.searchsorted(table[:, 0], length), np.searchsorted(table[:, 0], length, "right")
            at = low.copy()
            while len(open_ := np.flatnonzero(high - low > 0)):
                middle = (low[open_] + high[open_]) >> 1
                on = table[middle, 1] <= rank[open_]
                at[open_[on]] = middle[on]
                low[open_] = np.where(on, middle + 1, low[open_])
                high[open_] = np.where(on, high[open_], middle)
            use = table[at] if len(at) else np.zeros((0, 5), np.int64)
            inside = rank - use[:, 1]
            out = batch.drop_columns(["rank"])
            out = out.append_column("sequence_id", pa.array(use[:, 2] + inside // np.maximum(use[:, 3], 1)))
            yield out.append_column("offset", pa.array(use[:, 4] + inside % np.maximum(use[:, 3], 1) * length))

    schema = type(ranked.schema)([f for f in ranked.schema.fields if f.name != "rank"]).add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents, each with its sequence and its place there."""
    return placed(written(pieces(docs, doc_id, text, limit, tokenizer, with_ids), "pieces"), limit)


def sequences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, tokenizer: str | None = None) -> DataFrame:
    """sequence_id and its token ids, at most `limit`; what a training job reads."""
    found = packed(docs, doc_id, text, limit, tokenizer, True)
    return found.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
