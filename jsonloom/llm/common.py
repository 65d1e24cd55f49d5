"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python task holds at once, besides its arrays (about 20 bytes for each text byte).
BLOCK_BYTES = 4 << 20
#: glibc's way to give freed memory back; other C libraries do without.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Hands freed memory back to the system: Python workers live on from task to task, and stand beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of one of the input tables; nothing else is read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Without one there is no safe place for tables between steps, so this fails; only a
    session on one machine, as in tests, gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("jsonloom.scratch.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-jsonloom-")
        spark.conf.set("jsonloom.scratch.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str, done: tuple[DataFrame, ...] = ()) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and safe from lost executors.

    `done` are tables of this function that only df needed; they are deleted. Spark drops the shuffle files of a finished step
    once the driver has collected what refers to them, so that is asked for."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for old in done:
        deleted(old)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def deleted(table_: DataFrame) -> None:
    """Deletes the files of a table made by written()."""
    spark = table_.sparkSession
    folder = shared_folder(spark)
    for path in {f.rpartition("/")[0] for f in table_.inputFiles()}:
        if path.rpartition("/")[0].rpartition(":")[2].rstrip("/").endswith(folder.rpartition(":")[2].lstrip("/")):
            found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def id_text(doc_id: str, text: str, docs: DataFrame) -> DataFrame:
    """Just the id and the text, named so that other columns can't clash; a null text stays null."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """The rows of a task in tables of about `limit` bytes of text; a longer text is a table of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        start, total = 0, 0
        for end in range(batch.num_rows):
            total += int(lengths[end])
            if size + total >= limit:
                yield pa.Table.from_batches([*held, batch.slice(start, end + 1 - start)])
                held, size, start, total = [], 0, end + 1, 0
                give_back()
        if start < batch.num_rows:
            held.append(batch.slice(start))
            size += total
    if held:
        yield pa.Table.from_batches(held)
    held = []
    give_back()


def texts(block: pa.Table, column: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a column."""
    return block.column(column).cast(pa.binary()).to_pylist()


class Words:
    """Cuts texts into words, the runs of bytes that are no separators, and hashes them without a loop over words.

    A word of up to LONG bytes is taken in lanes of eight bytes, each mixed into the hash (words of one length up to eight bytes
    never hash alike); a longer one is hashed by xxh3. Hashes only find what may be equal: what is removed or looked up by them
    is compared by its bytes (see alike()). `bits` cuts hashes down, so that tests can make them collide."""

    LONG = 256

    def __init__(self, separators: bytes, lower: bool = False, bits: int = 64):
        self.word = np.ones(256, bool)
        self.word[list(separators)] = False
        self.lower, self.mask = lower, np.uint64((1 << bits) - 1)

    def spans(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word starts and ends."""
        edges = np.flatnonzero(np.diff(self.word[data].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        return edges[::2], edges[1::2]

    def shown(self, text: bytes) -> bytes:
        """A text as its words are compared: ASCII letters lower-cased, if that is asked for."""
        return text.lower() if self.lower else text

    def hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of words in data; at least eight bytes stand behind the last."""
        size = end - start
        out = mixed(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at, done = np.arange(len(start)) if size.max(initial=0) <= self.LONG else np.flatnonzero(size <= self.LONG), 0
        while len(at):
            out[at] = mixed((out[at] ^ lane(data, start[at] + done, size[at] - done)) * np.uint64(0xBF58476D1CE4E5B9))
            done += 8
            at = at[size[at] > done]
        for i in np.flatnonzero(size > self.LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].data)
        return out & self.mask

    def runs(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all k consecutive words."""
        return window_hashes(hashes, k) & self.mask

    def of(self, texts_: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words, and each text's number of words."""
        hashes, counts, _, _, _ = self.cut(texts_)
        return hashes, counts

    def cut(self, texts_: list[bytes | None], hashed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
        """Also where the words start and end in all texts, which are put together with spaces behind each."""
        joined_ = b" ".join([t or b"" for t in texts_] + [b" " * 8])
        data = np.frombuffer(self.shown(joined_), np.uint8)
        start, end = self.spans(data)
        ends = np.cumsum([len(t or b"") + 1 for t in texts_], dtype=np.int64)
        hashes = self.hashes(data, start, end) if hashed else np.empty(0, np.uint64)
        return hashes, np.diff(np.searchsorted(start, np.r_[0, ends])), start, end, joined_

    def spaced(self, texts_: list[bytes | None], hashed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
        """As cut(), with one space behind each word and no other separators, so that a run of words is one slice."""
        data = np.frombuffer(self.shown(b" ".join([t or b"" for t in texts_] + [b" "])), np.uint8)
        start, end = self.spans(data)
        counts = np.diff(np.searchsorted(start, np.r_[0, np.cumsum([len(t or b"") + 1 for t in texts_], dtype=np.int64)]))
        word = self.word[data]
        kept = word | np.r_[False, word[:-1]]
        out = np.where(word, data, np.uint8(0x20))[kept]
        sizes = end - start
        start = np.cumsum(sizes + 1) - sizes - 1
        out = np.r_[out, np.full(8, 0x20, np.uint8)]
        return self.hashes(out, start, start + sizes) if hashed else np.empty(0, np.uint64), counts, start, start + sizes, out.tobytes()


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def lane(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes, or the `left` bytes that there are, from each place on; eight bytes must stand behind the last."""
    eight = np.ndarray((max(len(data) - 7, 0),), "<u8", data, 0, (1,))
    return eight[at] & _MASKS[np.minimum(left, 8)]


def alike(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether the words of two lists are the same, byte by byte; at least eight bytes stand behind the last of each."""
    out = (end - start) == (other_end - other_start)
    at, done = np.flatnonzero(out), 0
    while len(at):
        same = lane(data, start[at] + done, end[at] - start[at] - done) == lane(other, other_start[at] + done, end[at] - start[at] - done)
        out[at[~same]] = False
        done += 8
        at = at[same & (end[at] - start[at] > done)]
        if done >= Words.LONG:
            for i in at.tolist():
                out[i] = data[start[i] : end[i]].tobytes() == other[other_start[i] : other_end[i]].tobytes()
            break
    return out


#: Words between ASCII white space, as they are or with ASCII letters lower-cased.
WHITE = b"\t\n\x0b\x0c\r "
PLAIN, LOWERED = Words(WHITE), Words(WHITE, True)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of two runs each, in order."""
    out = left * np.uint64(0x9E3779B97F4A7C15) + right
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive word hashes, put together from runs of powers of two."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, size, done, out = words, 1, 0, np.full(n, k, np.uint64)
    while size <= k:
        if k & size:
            out = joined(out, power[done : done + n])
            done += size
        if 2 * size <= k:
            power = joined(power[:-size], power[size:])
        size *= 2
    return out


def window_starts(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where in all words the windows of k words of one document start, and how many each document has."""
    number = np.maximum(counts - k + 1, 0)
    first = np.cumsum(counts) - counts
    return np.arange(int(number.sum())) + np.repeat(first - (np.cumsum(number) - number), number), number


def sliding_min(values: np.ndarray, k: int) -> np.ndarray:
    """The least of each k consecutive values."""
    span = 1
    while 2 * span <= k:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (k - span)], values[k - span :]) if k > span else values


def mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one scramble."""
    out = values ^ (values >> np.uint64(32))
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out
