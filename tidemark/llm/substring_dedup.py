"""Substring dedup (op9): long word spans that also stand in an earlier document are removed.

De Bruijn compaction. The edges are windows of 13 words, from the node of their
first 12 words to that of their last 12; a word is repeated if an edge covers
it whose word sequence also starts in a document with a smaller doc_id.

1. `Blocks`: consecutive edges that share their minimiser (the least hash of the
   4-word anchors inside) are a nonbranching path within their text, and travel
   as one row to the bucket of that anchor. Neighbouring blocks of a text
   overlap in 12 words, a node. Equal edges have equal anchors, so they meet.
2. `_compare`: equal blocks are repeated in all documents but the smallest. Where
   an anchor has several blocks that agree on one side, paths branch inside
   them: one document of each sends its single edges, which are compared alone.
3. `compacted`: two repeated blocks that follow each other in a document are a
   link. A node is nonbranching if its block has one successor and that one has
   one predecessor, in all documents; joins find these nodes, and blocks across
   them grow together to one long path in each document that has it.
4. A path returns to its source coordinates (document, first and last word) with
   the sum of its blocks' hashes; the document hashes its words again and
   removes those of paths that it verifies.

Blocks are compared by 128 bits, 96 of them over all their words. A map task
sends each distinct block once, whatever the number of copies; the other copies
are settled in the task itself.

Null and empty texts have no words. Rows without doc_id are returned with all
their words kept. Rows that share a doc_id are one document: they do not remove
each other's words. Extra columns are ignored by the digest and kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import passages
from . import words as W
from .exchange import HOLD, beside, buckets, by_bucket, classes, heads, of_doc, pack, to_bucket, unpack
from .session import stage

WINDOW, ANCHOR = 13, 4
WHOLE, CHECK, SINGLE = 0, 1, 2
OFTEN, HOTTEST = 1024, 4096  #: followers from which a block's link is broadcast, and how many are at most

_ROW = {"h": "<u4", "b": "<u8", "c": "<u4", "side": "<u4", "doc": "<i8", "start": "<i4", "n": "<u2"}
_LATER = {"vdoc": "<i8", "vstart": "<i4", "vn": "<u2", "vkey": "<u8"}
_PACKED = "bucket int, " + ", ".join(f"{c} binary" for c in (*_ROW, *_LATER))
MARKS = "doc_id long, kind int, start int, n int, key long"


def key_of(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return W.mix(b + W.mix(c.astype(np.uint64)))


class Blocks:
    """The blocks of the texts of one chunk: start and stop (words), text, anchor hash h, hashes b and c of all words, side, key."""

    def __init__(self, words: np.ndarray, first: np.ndarray, window: int, anchor: int):
        at = W.starts_of(first, window)
        self.words, self.window = words, window
        if not len(at):
            self.start = self.stop = self.doc = np.zeros(0, np.int64)
            self.h = self.b = self.key = np.zeros(0, np.uint64)
            self.c = self.side = np.zeros(0, np.uint32)
            return
        anchors = W.runs(words, anchor)
        least = W.sliding_argmin(anchors, window - anchor + 1)[at]
        new = np.flatnonzero((np.diff(least, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
        self.start, p = at[new], least[new]
        self.stop = at[np.append(new[1:], len(at)) - 1] + window  # after the last word
        self.doc = np.searchsorted(first, self.start, "right") - 1
        self.h = anchors[p]
        n = self.stop - self.start
        self.b, self.c = W.spans(words, self.start, n), (W.spans(words, self.start, n, 1) >> np.uint64(32)).astype(np.uint32)
        near = (window - anchor) // 2
        left, right = p - near, p + anchor
        has_l, has_r = left >= first[self.doc], right + near <= first[self.doc + 1]
        about = W.runs(words, near) >> np.uint64(48) | np.uint64(1) if near else np.ones(len(words) + 1, np.uint64)
        self.side = (np.where(has_l, about[np.maximum(left, 0)], 0).astype(np.uint32) << np.uint32(16)) | np.where(has_r, about[np.minimum(right, len(about) - 1)], 0).astype(np.uint32)
        self.key = key_of(self.b, self.c)


def _marks(doc: np.ndarray, kind: int, start: np.ndarray, n: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(np.full(len(doc), kind, np.int32)), pa.array(start, pa.int32()), pa.array(n.astype(np.int32)), pa.array(key.view(np.int64))], [x.split()[0] for x in MARKS.split(", ")])


def _shared(*keys: np.ndarray) -> np.ndarray:
    """Whether another row has the same keys."""
    order = np.lexsort(keys)
    new = heads(*(k[order] for k in keys))
    out = np.zeros(len(order), bool)
    out[order] = ~new | ~np.append(new[1:], True)
    return out


def _send(found: list[tuple], n: int) -> pa.RecordBatch:
    """One document of each class goes to the bucket of h; the class's other documents are settled here."""
    row = dict(zip(_ROW, (np.concatenate(x) for x in zip(*found, strict=True)), strict=True))
    order, cls, least = classes([row["h"], row["b"], row["c"]], row["doc"])
    row = {c: x[order] for c, x in row.items()}
    later = row["doc"] > least[cls]
    one = {c: x[~later].astype(k) for (c, x), k in zip(row.items(), _ROW.values(), strict=True)}
    a = pack(to_bucket(W.mix(one["h"].astype(np.uint64)), n), one)
    doc, key = row["doc"][later], key_of(row["b"][later], row["c"][later])
    b = pack(of_doc(doc, n), {"vdoc": doc, "vstart": row["start"][later].astype("<i4"), "vn": row["n"][later].astype("<u2"), "vkey": key})
    return beside([a, b], ["bucket", *_ROW, *_LATER])


def _sender(n: int, of: Callable[[pa.RecordBatch], Iterator[tuple]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x in of(batch):
                held.append(x)
                size += len(x[0])
                if size >= HOLD:
                    yield _send(held, n)
                    held, size = [], 0
        if size:
            yield _send(held, n)

    return run


def _compare(kind: int) -> Callable[[pa.Table], pa.Table]:
    """In a bucket: equal blocks are repeated in all documents but the least; blocks that branch are to be checked."""

    def run(table: pa.Table) -> pa.Table:
        row = {c: unpack(table, c, k) for c, k in _ROW.items()}
        out = [_marks(unpack(table, "vdoc", "<i8"), kind, unpack(table, "vstart", "<i4"), unpack(table, "vn", "<u2"), unpack(table, "vkey", "<u8"))]
        if len(row["h"]):
            order, cls, least = classes([row["h"], row["b"], row["c"]], row["doc"])
            row = {c: x[order] for c, x in row.items()}
            key, later = key_of(row["b"], row["c"]), row["doc"] > least[cls]
            out.append(_marks(row["doc"][later], kind, row["start"][later], row["n"][later], key[later]))
            if kind == WHOLE:
                head = np.flatnonzero(np.diff(cls, prepend=-1) != 0)
                head = head[_shared(row["h"][head])]  # an anchor with several blocks
                h, s = row["h"][head], row["side"][head]
                left, right = s >> np.uint32(16), s & np.uint32(0xFFFF)
                at = head[(_shared(h, left) & (left > 0)) | (_shared(h, right) & (right > 0))]
                out.append(_marks(row["doc"][at], CHECK, row["start"][at], row["n"][at], key[at]))
        return pa.Table.from_batches(out)

    return run


def _of_doc(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    return key ^ W.mix(row.astype(np.uint64) + np.uint64(7))


def compacted(marks: DataFrame, alone: DataFrame, window: int) -> DataFrame:
    """doc_id, start, stop, mark of the longest nonbranching paths of repeated blocks (doc_id, start, n, key). alone: doc_ids that several texts share; their blocks stay single."""
    of = Window.partitionBy("doc_id").orderBy("start", "key")
    meets = F.col("start") == F.lag(F.col("start") + F.col("n")).over(of) - (window - 1)
    steps = stage(marks.select("doc_id", "start", "n", "key").withColumn("before", F.when(meets, F.lag("key").over(of))), "steps")
    links = steps.where("before IS NOT NULL")
    after = stage(links.groupBy(F.col("before").alias("u")).agg(F.min("key").alias("v"), F.max("key").alias("w"), F.count("*").alias("k")), "after")
    hot = [r["u"] for r in after.where(F.col("k") > OFTEN).orderBy(F.desc("k"), "u").limit(HOTTEST).select("u").collect()]
    leaves = after.where("v = w").select("u", "v")  # out-degree 1
    enters = links.groupBy("key").agg(F.min("before").alias("u"), F.max("before").alias("w")).where("u = w").select("u", F.col("key").alias("v"))  # in-degree 1
    open_ = leaves.join(enters, ["u", "v"]).select(F.col("u").alias("before"), F.col("v").alias("key"), F.lit(0).alias("same"))
    often = F.col("before").isin(hot) if hot else F.lit(False)
    known = links.where(~often).join(open_.where(~often), ["before", "key"], "left")
    if hot:  # a block in very many documents has at most one open link, which goes to all tasks
        known = known.unionByName(links.where(often).join(F.broadcast(open_.where(often)), ["before", "key"], "left"))
    known = known.unionByName(steps.where("before IS NULL").withColumn("same", F.lit(None).cast("int")))  # path heads join nothing
    known = known.join(alone.select("doc_id", F.lit(1).alias("apart")), "doc_id", "left")
    run = F.sum(F.when(F.col("apart").isNull(), F.coalesce("same", F.lit(1))).otherwise(1)).over(of.rowsBetween(Window.unboundedPreceding, 0))
    return known.withColumn("run", run).groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("stop"), F.expr("bit_xor(key)").alias("mark")).select("doc_id", "start", "stop", "mark")


def find(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Repeated paths of docs (doc_id, text): doc_id, start, stop, mark."""
    n = buckets(docs)

    def blocks_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        for part, s, e, first, ids, _ in passages.parts(batch):
            x = Blocks(W.hash_spans(part, s, e), first, window, anchor)
            if len(x.start):
                yield (x.h >> np.uint64(32)).astype(np.uint32), x.b, x.c, x.side, ids[x.doc], (x.start - first[x.doc]).astype(np.int32), (x.stop - x.start).astype(np.uint16)

    def edges_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        for part, s, e, first, ids, rows in passages.parts(batch):
            x = Blocks(W.hash_spans(part, s, e), first, window, anchor)
            column = rows.column("checks")
            asked = _of_doc(np.asarray(column.flatten()).astype(np.int64).view(np.uint64), np.repeat(np.arange(len(rows)), np.asarray(pc.fill_null(pc.list_value_length(column), 0))))
            at = np.flatnonzero(np.isin(_of_doc(x.key, x.doc), asked))
            k = x.stop[at] - window + 1 - x.start[at]
            if len(at):
                start = np.repeat(x.start[at] - np.cumsum(k) + k, k) + np.arange(k.sum())
                doc, size = np.repeat(x.doc[at], k), np.full(len(start), window)
                b, c = W.spans(x.words, start, size), (W.spans(x.words, start, size, 1) >> np.uint64(32)).astype(np.uint32)
                yield (b >> np.uint64(32)).astype(np.uint32), b, c, np.zeros(len(b), np.uint32), ids[doc], (start - first[doc]).astype(np.int32), size.astype(np.uint16)

    own = docs.select("doc_id", "text")
    marks = stage(by_bucket(own.mapInArrow(_sender(n, blocks_of), _PACKED), _compare(WHOLE), MARKS, n), "marks")
    checks = marks.where(F.col("kind") == CHECK).groupBy("doc_id").agg(F.collect_set("key").alias("checks"))
    asked = docs.join(checks.hint("shuffle_hash"), "doc_id").mapInArrow(_sender(n, edges_of), _PACKED)
    single = by_bucket(asked.select(*(x.split()[0] for x in _PACKED.split(", "))), _compare(SINGLE), MARKS, n)
    alone = docs.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    paths = compacted(marks.where(F.col("kind") == WHOLE), alone, window)
    return paths.unionByName(single.select("doc_id", "start", (F.col("start") + F.col("n")).alias("stop"), F.col("key").alias("mark")))


def verifier(window: int, anchor: int) -> passages.Verify:
    def verify(words: np.ndarray, first: np.ndarray, row: np.ndarray, start: np.ndarray, stop: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Whether the blocks from start to stop of the row have the path's hashes, or its one edge has."""
        x = Blocks(words, first, window, anchor)
        if not len(x.start):
            return np.zeros(len(start), bool)
        a, b = np.searchsorted(x.start, start), np.searchsorted(x.stop, stop)
        a, b = np.minimum(a, len(x.start) - 1), np.minimum(b, len(x.start) - 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(x.key)))
        ok = (x.start[a] == start) & (x.stop[b] == stop) & (sums[b + 1] ^ sums[a] == mark)
        one = np.flatnonzero(~ok & (stop - start == window))
        size = np.full(len(one), window)
        edge = key_of(W.spans(words, start[one], size), (W.spans(words, start[one], size, 1) >> np.uint64(32)).astype(np.uint32))
        ok[one] = edge == mark[one]
        return ok

    return verify


def digest(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; rows without doc_id keep all words."""
    return passages.digest(docs, lambda own: find(own, window, anchor), verifier(window, anchor))


def clean(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The rows of docs, with their own columns. A text that loses words has its other words, joined by one space; a row that loses all its words goes; all else is as it was."""
    return passages.clean(docs, lambda own: find(own, window, anchor), verifier(window, anchor))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
