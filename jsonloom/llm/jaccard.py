"""N-gram Jaccard join by parity sketches: all documents whose shingle sets reach a similarity, as connected components.

A parity sketch has one 64-bit parity word for each of P parts: a shingle's hash names its part, and its other hash is
XORed into that part's word. Words that differ between two sketches are at most as many as the shingles that only one of the
two documents has. For sizes a and b, similarity s allows (a + b)(1 - s)/(1 + s) of those, T at most in a size band; with
more than T parts, two similar documents agree in a part. So a document is joined on the parts of its band, and of the next
band if it can have partners there.

P is T + 1 and some slack, so that similar documents agree in more parts than the slack. A document leaves out its parts with
under two shingles if the slack covers these, as they would join documents for one common shingle; else its empty parts, if
the slack covers them; else none. So no link is lost.

Documents that agree in a part are candidates, and a bucket's pairs are never made as rows: each document is compared with
two of the smallest documents of its buckets; where a bucket then still spans several components, its documents' parity bits are compared in
blocks inside tasks (2,048 bits or more for each, whose Hamming distance bounds the difference from below too), and only pairs that
may still link components leave the task. Every pair is at last verified on the exact shingle sets of whole texts. Equal sets
are one document until the end. Documents that share parts but no component cost comparisons by the square of their bucket.

Defined results: a document of fewer words than a shingle has its whole word sequence as its one shingle; without words it
has none and is a component of its own, as is a row with a null id (null); rows with equal ids are one document, linked with
what any of them is linked with; an empty table gives no rows; other columns than the id and the text are not read, so their names
can't clash; a very long text must fit in one task's memory. Hashes of 64 bits find candidates, sizes and parities; a link is
made by the words of both texts, and equal sets by a digest of 128 bits, of their words if they have up to FEW shingles.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jsonloom.llm.common import LOWERED, Words, blocks, id_text, joined, mixed, texts, window_starts, written

#: Shingle length, and similarity as a fraction.
SHINGLE, SIMILARITY = 4, (85, 100)
BAND, SLACK = 1.4, 0.16
BITS = 2048
#: Ids that may be broadcast, 8 bytes each; more are joined.
BROADCAST_IDS = 2_000_000
#: Documents of a bucket that are compared in one task, with as many others.
BLOCK = 2048
DEALT = "hash long, doc long, more array<long>"


def collapsed(hashes: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    """A row for each hash: the smallest document that has it, and the others."""
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])] if len(order) else np.zeros(0, bool)
    hashes, docs = hashes[new], docs[new]
    first = np.r_[True, hashes[1:] != hashes[:-1]] if len(hashes) else np.zeros(0, bool)
    sizes = np.diff(np.r_[np.flatnonzero(first), len(hashes)]) - 1
    more = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(docs[~first]), mask=pa.array(sizes == 0))
    return pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(docs[first]), more], names=["hash", "doc", "more"])


def shingle_sets(rows: list[bytes | None], words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all documents, one after the other, their numbers, and the numbers of words."""
    hashes, counts = words.of(rows)
    start, number = window_starts(counts, k)
    all_ = words.runs(hashes, k)[start]
    sets, at, first = [], 0, 0
    for n, m in zip(counts.tolist(), number.tolist(), strict=True):
        if m:
            sets.append(np.unique(all_[at : at + m]))
        else:
            sets.append(words.runs(hashes[first : first + n], n) if n else np.empty(0, np.uint64))
        at, first = at + m, first + n
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.array([len(s) for s in sets], np.int64), counts


def exact_set(text: bytes, words: Words, k: int) -> set[bytes]:
    """The shingles of a text as their words."""
    own = words.shown(text).split()
    return {b" ".join(own[i : i + k]) for i in range(max(len(own) - k + 1, 1))} if own else set()


def bands(similarity: tuple[int, int], most: int) -> list[int]:
    """The least size of each band, up to one beyond `most`."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * BAND)))
    return [*out, max(out[-1] + 1, math.ceil(out[-1] * BAND))]


def difference(total: int | np.ndarray, similarity: tuple[int, int]) -> int | np.ndarray:
    """How many shingles two similar sets of so many in all can differ in."""
    return total * (similarity[1] - similarity[0]) // (similarity[1] + similarity[0])


#: Sets of so few shingles are told apart by their words, as one collision of hashes could make two such sets equal.
FEW = 8


def set_ids(rows: list[bytes | None], shingles: np.ndarray, sizes: np.ndarray, words: Words, k: int) -> list[bytes | None]:
    """A digest of each set, of its words if they are few; null for an empty one."""
    out, ends = [], np.cumsum(sizes).tolist()
    for text, n, end in zip(rows, sizes.tolist(), ends, strict=True):
        if n > FEW:
            out.append(hashlib.blake2b(shingles[end - n : end].tobytes(), digest_size=16).digest())
        else:
            out.append(hashlib.blake2b(b"\n".join(sorted(exact_set(text, words, k))), digest_size=16).digest() if n else None)
    return out


def signatures(shingles: np.ndarray, sizes: np.ndarray, similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """What the documents are joined on, and the number of the document of each."""
    least = np.array(bands(similarity, int(sizes.max(initial=1))), np.int64)
    own = np.searchsorted(least, sizes, "right") - 1
    keys, docs, up = [], [], 0
    while True:
        # the band of the pair's larger document: the document's own, then those above that its partners can be in
        band = np.minimum(own + up, len(least) - 2)
        here = (sizes > 0) & (own + up < len(least) - 1) & (sizes * similarity[1] >= similarity[0] * least[band] if up else True)
        if not here.any():
            break
        most = difference(2 * (least[band + 1] - 1), similarity)
        here &= most > 0  # no difference allowed: equal sets only
        parts = most + 1 + np.ceil(SLACK * (most + 1)).astype(np.int64)
        slack = parts - most - 1
        doc = np.repeat(np.arange(len(sizes)), np.where(here, sizes, 0))
        chosen = shingles[np.repeat(here, sizes)]
        part = (((chosen >> np.uint64(32)) * parts[doc].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])]) if len(doc) else np.empty(0, np.int64)
        if len(new):
            word, count = np.bitwise_xor.reduceat(mixed(joined(chosen, chosen)), new), np.diff(np.r_[new, len(doc)])
            doc, part = doc[new], part[new]
            many, some = (np.bincount(doc[count > least_], minlength=len(sizes)) for least_ in (1, 0))
            # how few shingles a part may have: two if the slack covers those with fewer, else one, else none
            least_count = np.where(parts - many <= slack, 2, np.where(parts - some <= slack, 1, 0))
            kept = count >= least_count[doc]
            salt = lambda d, p: joined(band[d].astype(np.uint64), p.astype(np.uint64))
            keys.append(joined(salt(doc[kept], part[kept]), word[kept]))
            docs.append(doc[kept])
            whole = np.flatnonzero(here & (least_count == 0))
            if len(whole):
                first = np.zeros(len(sizes), np.int64)
                first[whole] = np.cumsum(parts[whole]) - parts[whole]
                taken = np.zeros(int(parts[whole].sum()), bool)
                own_ = (least_count == 0)[doc]
                taken[first[doc[own_]] + part[own_]] = True
                place = np.flatnonzero(~taken)
                d = np.repeat(whole, parts[whole])[place]
                keys.append(joined(salt(d, place - first[d]), np.zeros(len(d), np.uint64)))
                docs.append(d)
        up += 1
    return (np.concatenate(keys), np.concatenate(docs)) if keys else (np.empty(0, np.uint64), np.empty(0, np.int64))


def parity_bits(shingles: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Parity bits of each set: a power of two of them, 2,048 at least and four for each shingle."""
    width = np.maximum(BITS, 1 << np.ceil(np.log2(np.maximum(4 * sizes, 1))).astype(np.int64))
    first = np.cumsum(width) - width
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = first[doc] + (mixed(shingles) & (width[doc] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(width.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[a : a + n] for a, n in zip((first // 8).tolist(), (width // 8).tolist(), strict=True)]


def folded(bits: list[bytes], size: int) -> np.ndarray:
    """Parity bits of some sets as rows of `size` bytes: halves are XORed until they are that short."""
    out = np.empty((len(bits), size // 8), np.uint64)
    for i, b in enumerate(bits):
        row = np.frombuffer(b, np.uint64)
        out[i] = row if len(b) == size else np.bitwise_xor.reduce(row.reshape(-1, size // 8), axis=0)
    return out


class Join:
    """One run over a table of documents: its sizes and sketches, its buckets, and the components found so far."""

    def __init__(self, docs: DataFrame, words: Words, k: int, similarity: tuple[int, int]):
        self.docs, self.words, self.k, self.similarity = docs, words, k, similarity
        self.all = written(self._sizes(), "sizes")
        known = self.all.where("doc is not null and n > 0")
        # written, so that the join has exchanges of its own, whose hot parts adaptive execution can split
        first = written(known.groupBy("set").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("set", "first"), "firsts")
        #: edges from the smallest document with a set to the others
        self.equal = written(known.join(first, "set").where("doc <> first").select(F.col("first").alias("a"), F.col("doc").alias("b")), "equal")
        self.sketches = written(known.groupBy("doc").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.any_value("bits").alias("bits")), "sketches")

    def _sizes(self) -> DataFrame:
        words, k = self.words, self.k

        def measure(batches):
            for rows in blocks(batches):
                own = texts(rows)
                shingles, sizes, _ = shingle_sets(own, words, k)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), pa.array(sizes), pa.array(set_ids(own, shingles, sizes, words, k), pa.binary()), pa.array(parity_bits(shingles, sizes), pa.binary())], names=["doc", "n", "set", "bits"])

        return self.docs.mapInArrow(measure, "doc long, n long, set binary, bits binary")

    def buckets(self) -> DataFrame:
        """(key, doc): where different sets agree in a part; of equal sets the first, of equal buckets one."""
        words, k, similarity = self.words, self.k, self.similarity

        def sign(batches):
            for rows in blocks(batches):
                key, doc = signatures(*shingle_sets(texts(rows), words, k)[:2], similarity)
                made = collapsed(key, rows.column("doc_id").to_numpy()[doc])
                for at in range(0, made.num_rows, 200_000):
                    yield made.slice(at, 200_000)

        single = self.sketches.where("rows = 1").select("doc")
        copies = self.equal.select(F.col("b").alias("doc")).join(single, "doc", "left_semi").select(F.col("doc").alias("doc_id"))
        copies = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
        dealt = self.docs.where("doc_id is not null").join(copies, "doc_id", "left_anti").mapInArrow(sign, DEALT).where("hash is not null").repartition("hash")
        # a bucket is named by the documents in it; its rows are only read in passing, so that a hot one takes no memory
        def folded_ids(salt: int):
            return F.aggregate(F.coalesce("more", F.array().cast("array<long>")), F.xxhash64("doc", F.lit(salt)), lambda s, d: s.bitwiseXOR(F.xxhash64(d, F.lit(salt))))

        bucket = dealt.groupBy("hash").agg(F.sum(F.lit(1) + F.coalesce(F.size("more"), F.lit(0))).alias("n"), *[F.bit_xor(folded_ids(i)).alias(f"x{i}") for i in (0, 1)]).where("n > 1")
        rows = dealt.join(bucket, "hash").select(F.xxhash64("n", "x0", "x1").alias("key"), F.explode(F.concat(F.array("doc"), F.coalesce("more", F.array().cast("array<long>")))).alias("doc"))
        return written(rows.distinct(), "buckets")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are similar."""
        similarity, words, k = self.similarity, self.words, self.k
        side = lambda name: self.sketches.select(F.col("doc").alias(name), F.col("n").alias(f"n_{name}"), F.col("rows").alias(f"rows_{name}"), F.col("bits").alias(f"bits_{name}"))

        def hold(batches):
            for batch in batches:
                n = {x: batch.column(f"n_{x}").to_numpy() for x in "ab"}
                bits = {x: batch.column(f"bits_{x}").to_pylist() for x in "ab"}
                width = np.array([min(len(x), len(y)) for x, y in zip(bits["a"], bits["b"], strict=True)], np.int64)
                apart = np.zeros(len(width), np.int64)
                for size in set(width.tolist()):
                    at = np.flatnonzero(width == size).tolist()
                    apart[at] = np.bitwise_count(folded([bits["a"][i] for i in at], size) ^ folded([bits["b"][i] for i in at], size)).sum(1)
                near = (apart <= difference(n["a"] + n["b"], similarity)) & (np.minimum(n["a"], n["b"]) * similarity[1] >= np.maximum(n["a"], n["b"]) * similarity[0])
                # rows that share an id have no one sketch
                near |= (batch.column("rows_a").to_numpy() > 1) | (batch.column("rows_b").to_numpy() > 1)
                yield batch.select(["a", "b"]).filter(pa.array(near))

        near = written(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "rows_a", "rows_b", "bits_a", "bits_b").mapInArrow(hold, "a long, b long"), "near")
        ids = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        held = self.docs.join(ids, "doc_id", "left_semi")
        both = near.join(held.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b").join(held.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")

        def compare(batches):
            kept: dict[int, tuple[bytes, np.ndarray]] = {}

            def shingles(doc: int, text: bytes) -> np.ndarray:
                if doc not in kept or kept[doc][0] != text:
                    if len(kept) >= 64:
                        kept.clear()
                    kept[doc] = (text, shingle_sets([text], words, k)[0])
                return kept[doc][1]

            def holds(common: int, left: int, right: int) -> bool:
                return common * similarity[1] >= similarity[0] * (left + right - common)

            for batch in batches:
                a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                same = []
                for i, s, j, t in zip(a, texts(batch, "text_a"), b, texts(batch, "text_b"), strict=True):
                    left, right = shingles(i, s), shingles(j, t)
                    common = len(np.intersect1d(left, right, assume_unique=True))
                    # a link is held by the words themselves
                    link = holds(common, len(left), len(right))
                    if link:
                        x, y = exact_set(s, words, k), exact_set(t, words, k)
                        link = holds(len(x & y), len(x), len(y))
                    same.append(link)
                yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

        return both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")

    def components(self) -> DataFrame:
        """(doc, component) for each document that has a link; the component is its smallest document."""
        buckets = self.buckets()
        ends = buckets.groupBy("key").agg(F.min("doc").alias("a"))
        pairs = buckets.join(ends, "key").where("doc <> a").groupBy("a", F.col("doc").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
        # of a document's bucket ends the one of most buckets, and the smallest; what this leaves is compared below
        best = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("most"), F.min("a").alias("least"))
        pairs = best.select(F.explode(F.array_distinct(F.array("most", "least"))).alias("a"), "b")
        labels = components(self.verified(pairs).unionByName(self.equal))
        for spanning in (True, False):
            new = written(self.verified(self.apart(buckets, labels, spanning)), "edges")
            if not new.isEmpty():
                labels = components(new.unionByName(labels.select(F.col("component").alias("a"), F.col("doc").alias("b"))))
        return labels

    def apart(self, buckets: DataFrame, labels: DataFrame, spanning: bool) -> DataFrame:
        """Pairs (a, b) of a bucket in different components whose parity bits allow a link; with `spanning`, in each bucket
        only those that would join its components if all held, nearest first.

        Only buckets with several components are dealt out, each to one task; one of over BLOCK documents goes to a task for
        each two blocks of it. The pairs are compared there and never become rows."""
        placed = buckets.join(labels, "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("component"))
        several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members")).where("low < high")
        rows = placed.join(several.select("key", "members"), "key").join(self.sketches, "doc")
        parts = F.ceil(F.col("members") / BLOCK).cast("int")
        rows = rows.withColumn("own", F.pmod(F.xxhash64("doc"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        rows = rows.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "doc", "component", "n", "rows", "bits")
        similarity = self.similarity

        def compare(batches):
            held: list[pa.RecordBatch] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                groups = np.stack([batch.column(c).to_numpy() for c in ("key", "p", "q")])
                cuts = [0, *(np.flatnonzero((groups[:, 1:] != groups[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
                for low, high in zip(cuts, cuts[1:], strict=False):
                    part = batch.slice(low, high - low)
                    if held and any(held[0].column(c)[0] != part.column(c)[0] for c in ("key", "p", "q")):
                        yield _pairs(held, similarity, spanning)
                        held = []
                    held.append(part)
            if held:
                yield _pairs(held, similarity, spanning)

        dealt = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
        return dealt.mapInArrow(compare, "a long, b long").distinct()


def _pairs(held: list[pa.RecordBatch], similarity: tuple[int, int], spanning: bool) -> pa.RecordBatch:
    """What apart() returns of one group of rows."""
    group = pa.Table.from_batches(held)
    doc, component, n, many, own = (group.column(c).to_numpy() for c in ("doc", "component", "n", "rows", "own"))
    bits = group.column("bits").to_pylist()
    bits = folded(bits, min(map(len, bits)))
    across = group.column("p")[0] != group.column("q")[0]
    left, right, apart = [], [], []
    step = max(1, (1 << 19) // (len(doc) * bits.shape[1]))
    for at in range(0, len(doc), step):
        to = slice(at, at + step)
        distance = np.bitwise_count(bits[to, None] ^ bits[None]).sum(2, dtype=np.int32)
        near = (distance <= difference(n[to, None] + n[None], similarity)) & (np.minimum(n[to, None], n[None]) * similarity[1] >= np.maximum(n[to, None], n[None]) * similarity[0])
        near |= (many[to, None] > 1) | (many[None] > 1)  # rows that share an id have no one sketch
        near &= (component[to, None] != component[None]) & (doc[to, None] < doc[None])
        if across:
            near &= own[to, None] != own[None]
        i, j = np.nonzero(near)
        left.append(i + at)
        right.append(j)
        apart.append(distance[i, j])
    left, right, apart = np.concatenate(left), np.concatenate(right), np.concatenate(apart)
    if spanning and len(left):
        root = {c: c for c in set(component.tolist())}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        kept = []
        for x in np.argsort(apart, kind="stable").tolist():
            a, b = top(int(component[left[x]])), top(int(component[right[x]]))
            if a != b:
                root[a] = b
                kept.append(x)
        left, right = left[kept], right[kept]
    return pa.RecordBatch.from_arrays([pa.array(doc[left]), pa.array(doc[right])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(doc, component) of the documents on edges (a, b), by stars: large stars hang a document's larger neighbours on its
    smallest, small stars its smaller ones; it ends when every edge leads to the smallest document."""
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        # in `large` each edge leads up, from a to b: b's smallest smaller neighbour
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lower, "b")
        small = small.select(F.col("m").alias("a"), "b").unionByName(small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        edges = written(small, "stars")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("doc"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("doc"), F.col("a").alias("component")).distinct())


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, words: Words = LOWERED) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    join = Join(id_text(doc_id, text, docs), words, k, similarity)
    return join.all.select("doc", "n").join(join.components(), "doc", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, similarity: tuple[int, int] = (80, 100), words: Words = LOWERED) -> DataFrame:
    """(doc_id): the documents that are not the smallest of their component; all others stay."""
    return linked(docs, doc_id, text, k, similarity, words).where("doc_id <> component_id").select("doc_id").distinct()


# ---- query ----


def digests(documents: DataFrame) -> DataFrame:
    return linked(documents)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (SELECT doc_id, doc_id AS t FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.t)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(t) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
