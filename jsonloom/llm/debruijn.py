"""Substring dedup on a token de Bruijn graph: repeated spans are compacted paths, verified at their source.

The edges are the runs of 13 words (k-mers) of all documents, the nodes the runs of 12 words between them.

1. Anchors (see anchors): edges whose minimiser only one document has can't repeat and never become rows.
2. Edges that follow each other in a document and share a minimiser are put together where they lie, into a chain, which leads
   from its first 12 words to its last 12. Chains are dealt by their content; a chain of two documents or more is an edge of
   the compacted graph, and its source is where the document with the smallest id has it (document, position).
3. Nodes of the repeated chains get their in- and out-degrees. A node of degrees 1 and 1 is no branch: the chains before and
   behind it go together. Chains that also follow each other at their source are joined in one pass over the source, the rest
   by joins that double the distance at each round. This gives the unitigs: longest paths without a branch.
4. Chains that are not whole in a smaller document are opened, and their edges dealt one by one: where a passage starts or ends
   within a chain, this finds its edges and their sources.
5. Each document puts together what it has learned: edges in a row with sources in a row are a span. A span's words are
   compared with those at its source's coordinates, by SHA-256 of both; each distinct span is asked for once. Only verified
   spans go.

Hashes of 64 bits find what may be equal; they never decide. If a span fails, all edges that share a hash with one of its own
are settled anew by the SHA-256 of their words, over all documents, so chance or crafted collisions cost time, not results.

What is hot: a block of documents deals one row for each chain or edge (see anchors), and documents that share it with another
of their block have this one as their source. Tables between steps are Parquet in the shared folder.

Words are runs without ASCII white space, unchanged. Defined results: a null or empty text has no words; a document of fewer
than 13 words keeps them all; of equal documents the one with the smallest id keeps its words, and rows with equal ids are
not compared with each other; a row with a null id keeps its words and is no source; an empty table gives no rows; other
columns than the id and the text are not read, so their names can't clash. A text must fit in one task's memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jsonloom.llm.anchors import anchors_of, changes, chosen, cut_out, first_of, repeated_anchors, salts
from jsonloom.llm.common import PLAIN, Words, blocks, deleted, id_text, joined, texts, written

WINDOW, ANCHOR = 13, 5
#: Ids or hashes that may be broadcast, 8 bytes each; more are joined.
BROADCAST_IDS = 2_000_000
FOUND = "array<struct<hash:bigint,src:bigint,at:int>>"
CHAIN = "hash long, salt long, doc long, src long, at int, n int, more boolean, head long, tail long"
EDGE = "hash long, salt long, doc long, src long, at int"


class Chains:
    """The edges of a block of documents that have repeated anchors, and the chains that they make."""

    def __init__(self, rows: pa.Table, words: Words, hashes: np.ndarray, counts: np.ndarray, window: int, anchor: int):
        start, doc, least, _ = anchors_of(words, hashes, counts, window, anchor)
        wanted = chosen(least, doc, rows.column("anchors"))
        self.start, self.doc, least, number = start[wanted], doc[wanted], least[wanted], np.flatnonzero(wanted)
        self.ids = rows.column("doc_id").fill_null(0).to_numpy()
        self.at = self.start - (np.cumsum(counts) - counts)[self.doc]
        self.edges = words.runs(hashes, window)[self.start]
        new = changes(least, self.doc, number - np.arange(len(number)))
        self.first = np.flatnonzero(new)
        self.chain = np.cumsum(new) - 1
        self.along = np.arange(len(number)) - self.first[self.chain] if len(number) else np.empty(0, np.int64)
        self.size = np.diff(np.r_[self.first, len(number)])
        self.hashes = (np.add.reduceat(joined(self.edges, self.along.astype(np.uint64)), self.first) if len(number) else np.empty(0, np.uint64)) & words.mask


def dealt(hashes: np.ndarray, docs: np.ndarray, at: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Rows (hash, salt, doc, src, at) for a block's chains or edges and the places that they come from: the first document with
    each is dealt by the hash, the others are told of the first."""
    order, first, place = first_of(hashes, docs)
    src = order[place]
    out = {"hash": hashes[order].view(np.int64), "salt": np.where(first, 0, salts(docs[order])), "doc": docs[order], "src": docs[src], "at": at[src].astype(np.int32)}
    return out | {"more": np.bincount(place, minlength=len(order))[place] > 1}, order


def chain_rows(docs: DataFrame, words: Words, window: int, anchor: int) -> DataFrame:
    def deal(batches):
        for rows in blocks(batches):
            hashes, counts = words.of(texts(rows))
            c = Chains(rows, words, hashes, counts, window, anchor)
            made, order = dealt(c.hashes, c.ids[c.doc[c.first]], c.at[c.first])
            nodes, start, size = words.runs(hashes, window - 1), c.start[c.first][order], c.size[order]
            made |= {"n": size.astype(np.int32), "head": nodes[start].view(np.int64), "tail": nodes[start + size].view(np.int64)}
            yield pa.RecordBatch.from_pydict({f.split()[0]: pa.array(made[f.split()[0]]) for f in CHAIN.split(", ")})

    return docs.mapInArrow(deal, CHAIN)


def unitigs(chains: DataFrame) -> DataFrame:
    """The compacted graph: hash, src, at, n of each repeated chain, and the unitig that it is part of, as the source (unitig_src,
    unitig_at) of its first chain and the number of edges before. `chains` is a table of chain_rows()."""
    found = chains.where("salt = 0").groupBy("hash").agg(*[F.min("src").alias("src"), F.min_by("at", "src").alias("at"), F.max("src").alias("high"), *[F.max(c).alias(c) for c in ("n", "more", "head", "tail")]])
    edges = written(found.where("src < high or more").drop("high", "more"), "chains")
    one, no = F.lit(1), F.lit(None).cast("long")
    ends = edges.select(F.col("head").alias("node"), F.lit(0).alias("ins"), one.alias("outs"), no.alias("prev"), F.col("hash").alias("next")).unionByName(
        edges.select(F.col("tail").alias("node"), one.alias("ins"), F.lit(0).alias("outs"), F.col("hash").alias("prev"), no.alias("next")))
    degrees = ends.groupBy("node").agg(F.sum("ins").alias("ins"), F.sum("outs").alias("outs"), F.max("prev").alias("prev"), F.max("next").alias("next"))
    plain = degrees.where("ins = 1 and outs = 1 and prev <> next").select("prev", F.col("next").alias("hash"))
    # along each source: a chain that goes on where the one before ends, over a node without a branch
    along = Window.partitionBy("src").orderBy("at", "hash")
    linked = edges.join(plain, "hash", "left")
    goes_on = (F.lag("hash").over(along) == F.col("prev")) & (F.lag("at").over(along) + F.lag("n").over(along) == F.col("at"))
    runs = linked.withColumn("goes_on", F.coalesce(goes_on, F.lit(False))).withColumn("run", F.max(F.when(~F.col("goes_on"), F.col("at"))).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = written(runs.select("hash", "src", "at", "n", "run", "goes_on", "prev"), "runs", done=(edges,))
    # runs of different sources: each points to the one before, then twice as far, until all point to a first one
    before = runs.select(F.col("hash").alias("prev"), F.col("src").alias("up_src"), F.col("run").alias("up"), (F.col("at") + F.col("n") - F.col("run")).alias("gap"))
    up = written(runs.where("not goes_on and prev is not null").join(before, "prev").select("src", "run", "up_src", "up", "gap"), "ups")
    left = up.count()
    while left:
        far = up.select(F.col("src").alias("up_src"), F.col("run").alias("up"), F.col("up_src").alias("far_src"), F.col("up").alias("far"), F.col("gap").alias("more"))
        step = up.join(far, ["up_src", "up"], "left")
        step = step.select("src", "run", F.coalesce("far_src", "up_src").alias("up_src"), F.coalesce("far", "up").alias("up"), (F.col("gap") + F.coalesce("more", F.lit(0))).alias("gap"), F.col("far").isNotNull().alias("moved"))
        step = written(step, "ups", done=(up,))
        moved, up = step.where("moved").count(), step.drop("moved")
        if moved == left:
            # each round settles some run of a path; what is left are rings, which have no first run, and their runs stay apart
            up = up.join(up.select(F.col("src").alias("up_src"), F.col("run").alias("up")), ["up_src", "up"], "left_anti")
            break
        left = moved
    out = runs.join(up, ["src", "run"], "left")
    return out.select("hash", "src", "at", "n", F.coalesce("up_src", "src").alias("unitig_src"), F.coalesce("up", "run").alias("unitig_at"), (F.coalesce("gap", F.lit(0)) + F.col("at") - F.col("run")).alias("before"))


def found_by_doc(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("hash", "src", "at")).alias(name))


def edge_rows(docs: DataFrame, words: Words, window: int, anchor: int) -> DataFrame:
    """The edges of the chains that are not whole in a smaller document."""

    def deal(batches):
        for rows in blocks(batches):
            c = Chains(rows, words, *words.of(texts(rows)), window, anchor)
            mine = ~chosen(c.hashes, c.doc[c.first], field(rows.column("chains"), "hash"))[c.chain]
            made, _ = dealt(c.edges[mine], c.ids[c.doc[mine]], c.at[mine])
            yield pa.RecordBatch.from_pydict({f.split()[0]: pa.array(made[f.split()[0]]) for f in EDGE.split(", ")})

    return docs.mapInArrow(deal, EDGE)


def field(lists: pa.ChunkedArray, name: str) -> pa.ChunkedArray:
    """Lists of structs as lists of one of their fields."""
    return pa.chunked_array([pa.ListArray.from_arrays(pa.array(np.asarray(x.offsets)), x.values.field(name), mask=x.is_null()) for x in lists.chunks], pa.list_(lists.type.value_type.field(name).type))


def sources(hashes: np.ndarray, doc: np.ndarray, lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For hashes in order of their documents: whether each is in its document's list, and the source that the list has for it."""
    has, src, at = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
    edges = np.searchsorted(doc, np.arange(len(lists) + 1))
    for low, high, *own in zip(edges.tolist(), edges[1:].tolist(), *(field(lists, f).to_numpy() for f in ("hash", "src", "at")), strict=False):
        if own[0] is not None and high > low and len(own[0]):
            # of several sources of one hash the one with the smallest id
            order = np.lexsort((own[2], own[1], own[0].view(np.uint64)))
            known = own[0].view(np.uint64)[order]
            place = np.minimum(np.searchsorted(known, hashes[low:high]), len(known) - 1)
            has[low:high], src[low:high], at[low:high] = known[place] == hashes[low:high], own[1][order][place], own[2][order][place]
    return has, src, at


def span_rows(docs: DataFrame, words: Words, window: int, anchor: int) -> DataFrame:
    """(doc_id, key, removed, asked) of each document with repeats: its spans, and those of them, with source and SHA-256, that no
    document before in its block has asked for."""
    schema = "doc_id long, key long, removed array<struct<start:int,length:int>>, asked array<struct<src:bigint,at:int,length:int,sha:binary>>"

    def gather(batches):
        for rows in blocks(batches):
            hashes, counts, start, end, data = words.spaced(texts(rows))
            c = Chains(rows, words, hashes, counts, window, anchor)
            has, src, at = (x[c.chain] for x in sources(c.hashes, c.doc[c.first], rows.column("chains")))
            one, src_one, at_one = sources(c.edges, c.doc, rows.column("edges"))
            src, at, has = np.where(has, src, src_one), np.where(has, at + c.along, at_one), has | one
            where = np.flatnonzero(has)
            new = np.flatnonzero(changes(c.doc[where], src[where], at[where] - c.at[where], c.start[where] - np.arange(len(where))))
            low, size = where[new], np.diff(np.r_[new, len(where)]) + window - 1
            out, seen = {}, set()
            for w, n in zip(low.tolist(), size.tolist(), strict=True):
                ask = (int(src[w]), int(at[w]), n, hashlib.sha256(data[start[c.start[w]] : end[c.start[w] + n - 1]]).digest())
                removed, asked = out.setdefault(int(c.doc[w]), ([], []))
                removed.append({"start": int(c.at[w]), "length": n})
                if ask not in seen:
                    seen.add(ask)
                    asked.append(dict(zip(("src", "at", "length", "sha"), ask, strict=True)))
            pick = pa.array(list(out), pa.int64())
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id").combine_chunks().take(pick), rows.column("key").combine_chunks().take(pick),
                pa.array([r for r, _ in out.values()], pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))),
                pa.array([a for _, a in out.values()], pa.list_(pa.struct([("src", pa.int64()), ("at", pa.int32()), ("length", pa.int32()), ("sha", pa.binary())]))),
            ], names=["doc_id", "key", "removed", "asked"])

    return docs.mapInArrow(gather, schema)


def failed(docs: DataFrame, spans: DataFrame, words: Words, window: int) -> DataFrame:
    """(sha, hash): of spans whose words are others at their source, and of all edges there."""
    asked = spans.select(F.explode("asked").alias("a")).select("a.*").distinct().groupBy("src").agg(F.collect_list(F.struct("at", "length", "sha")).alias("asked"))
    ids = asked.select(F.col("src").alias("doc_id"))
    few = ids.count() <= BROADCAST_IDS

    def compare(batches):
        for rows in blocks(batches):
            hashes, counts, start, end, data = words.spaced(texts(rows))
            edges, bad = words.runs(hashes, window), []
            for first, n, own in zip((np.cumsum(counts) - counts).tolist(), counts.tolist(), rows.column("asked").to_pylist(), strict=True):
                for x in own or ():
                    low, size = first + x["at"], x["length"]
                    if x["at"] + size > n or hashlib.sha256(data[start[low] : end[low + size - 1]]).digest() != x["sha"]:
                        bad += [(x["sha"], h) for h in [None, *edges[low : first + min(x["at"] + size, n) - window + 1].view(np.int64).tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in bad], pa.binary()), pa.array([h for _, h in bad], pa.int64())], names=["sha", "hash"])

    there = docs.join(F.broadcast(ids), "doc_id", "left_semi") if few else docs
    return there.join(asked.withColumnRenamed("src", "doc_id"), "doc_id").select("text", "asked").mapInArrow(compare, "sha binary, hash long").distinct()


def settled(docs: DataFrame, spans: DataFrame, bad: DataFrame, words: Words, window: int) -> DataFrame:
    """spans (doc_id, key, removed) with all edges of a hash in `bad`, or in a span that it names, settled by the SHA-256 of their
    words."""

    def own(batches):
        for rows in blocks(batches):
            hashes, counts, start, end, data = words.spaced(texts(rows))
            edges, made = words.runs(hashes, window).view(np.int64), []
            for first, spans_ in zip((np.cumsum(counts) - counts).tolist(), rows.column("removed").to_pylist(), strict=True):
                for x in spans_:
                    low, size = first + x["start"], x["length"]
                    made.append((hashlib.sha256(data[start[low] : end[low + size - 1]]).digest(), edges[low : low + size - window + 1]))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in made], pa.binary()), pa.array([b for _, b in made], pa.list_(pa.int64()))], names=["sha", "hashes"])

    mine = docs.join(spans, ["doc_id", "key"]).select("text", "removed").mapInArrow(own, "sha binary, hashes array<long>")
    mine = mine.join(bad.select("sha").distinct(), "sha", "left_semi").select(F.explode("hashes").alias("hash"))
    bad = written(bad.select("hash").where("hash is not null").unionByName(mine).distinct(), "bad")

    def digests_(batches):
        for rows in blocks(batches):
            hashes, counts, start, end, data = words.spaced(texts(rows))
            edges, made = words.runs(hashes, window).view(np.int64), []
            for first, n, doc, key in zip((np.cumsum(counts) - counts).tolist(), counts.tolist(), rows.column("doc_id").to_pylist(), rows.column("key").to_pylist(), strict=True):
                made += [(int(edges[w]), hashlib.sha256(data[start[w] : end[w + window - 1]]).digest(), doc, key, w - first) for w in range(first, first + n - window + 1)]
            yield pa.RecordBatch.from_pylist([dict(zip(("hash", "sha", "doc_id", "key", "at"), x, strict=True)) for x in made], pa.schema([("hash", pa.int64()), ("sha", pa.binary()), ("doc_id", pa.int64()), ("key", pa.int64()), ("at", pa.int32())]))

    few = bad.count() <= BROADCAST_IDS
    rows = docs.where("doc_id is not null").mapInArrow(digests_, "hash long, sha binary, doc_id long, key long, at int").join(F.broadcast(bad) if few else bad, "hash", "left_semi")
    rows = written(rows, "settled")
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("low"))
    exact = rows.join(first, "sha").select("doc_id", "key", "at", (F.col("low") < F.col("doc_id")).alias("gone")).distinct()
    before = spans.select("doc_id", "key", F.explode("removed").alias("r")).select("doc_id", "key", F.explode(F.sequence("r.start", F.col("r.start") + F.col("r.length") - window)).alias("at"))
    gone = before.join(exact, ["doc_id", "key", "at"], "left_anti").unionByName(exact.where("gone").drop("gone"))
    return gone.groupBy("doc_id", "key").agg(F.collect_list(F.struct(F.col("at").alias("start"), F.lit(window).alias("length"))).alias("removed"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, words: Words = PLAIN) -> DataFrame:
    """doc_id, n_words, removed (runs of words) and kept (the other words, joined by one space) of each row."""
    docs = id_text(doc_id, text, docs).withColumn("key", F.xxhash64("text"))
    some = docs.where("doc_id is not null")
    anchors = written(repeated_anchors(docs, words, window, anchor), "anchors")
    placed = some.join(anchors, "doc_id")
    chains = written(chain_rows(placed, words, window, anchor), "chains")
    graph = written(unitigs(chains), "unitigs")
    # the chains of each document that a smaller one has, by the unitigs' coordinates
    known = chains.join(graph.select("hash", F.lit(0).cast("long").alias("salt"), F.col("src").alias("first"), F.col("at").alias("place")), ["hash", "salt"], "left")
    told = known.where("salt <> 0 or first < doc").select("doc", "hash", F.when(F.col("salt") == 0, F.col("first")).otherwise(F.col("src")).alias("src"), F.when(F.col("salt") == 0, F.col("place")).otherwise(F.col("at")).alias("at"))
    known = placed.join(found_by_doc(told, "chains"), "doc_id", "left")
    edges = edge_rows(known, words, window, anchor).where("hash is not null and salt is not null and doc is not null").repartition("hash", "salt")
    # both sides take all columns and filter none, so that the edges are made and dealt once
    least = edges.groupBy("hash", "salt").agg(F.min("src").alias("first"), F.min_by("at", "src").alias("place"), F.max("doc").alias("high")).where("first < high").drop("high")
    told = edges.join(least, ["hash", "salt"]).where("first < doc").select("doc", "hash", F.least("first", "src").alias("src"), F.when(F.col("first") < F.col("src"), F.col("place")).otherwise(F.col("at")).alias("at"))
    known = known.join(found_by_doc(told, "edges"), "doc_id", "left")
    spans = written(span_rows(known, words, window, anchor), "spans", done=(anchors, chains, graph))
    bad = written(failed(some, spans, words, window), "failed")
    removed = spans.select("doc_id", "key", "removed")
    if not bad.isEmpty():
        removed = written(settled(some, removed, bad, words, window), "spans", done=(spans,))
    deleted(bad)
    return cut_out(docs, removed, words)


def digests(documents: DataFrame) -> DataFrame:
    found = deduplicated(documents)
    return found.select("doc_id", "n_words", F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["length"]).alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), f AS (SELECT g, min(doc_id) AS f FROM p GROUP BY g
), r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM p JOIN f USING (g) WHERE f < doc_id
), e AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d
), k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY e.j) AS kept FROM e ANTI JOIN r ON e.doc_id = r.doc_id AND e.j = r.j GROUP BY doc_id
), n AS (SELECT doc_id, count(*) AS n_removed FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
