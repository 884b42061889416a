"""Texts from which passages are removed: what op2 and op9 do with the spans that each of them finds by its own method."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .session import packed_rest, small_batches

#: Word coordinates of a passage in its document, and a hash of it by which the document verifies it before anything is removed.
FIELDS = "doc_id long, start int, stop int, mark long"

Verify = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def parts(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Chunks of rows that have doc_id: word hashes, first words, doc_ids, rows."""
    if batch.column("doc_id").null_count:
        batch = batch.filter(pc.is_valid(batch.column("doc_id")))
    buf, offsets = W.buffers(batch.column("text"))
    ids = np.asarray(batch.column("doc_id")).astype(np.int64)
    for i, j in W.chunks(offsets):
        part, off = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        s, e, first = W.split(part, off, W.BLANK_SPLIT)
        yield part, s, e, first, ids[i:j], batch.slice(i, j - i)


def spans_of(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(mark.view(np.int64))], [x.split()[0] for x in FIELDS.split(", ")])


def kept(first: np.ndarray, gone: np.ndarray, texts) -> list[bytes]:
    out = []
    for i, text in enumerate(texts):
        words, cut = text.split(), gone[first[i] : first[i + 1]]
        if cut.any():
            words = [w for w, g in zip(words, cut.tolist(), strict=True) if not g]
        out.append(b" ".join(words))
    return out


def _digest(ids, texts, first, gone, rows) -> pa.RecordBatch:
    left = kept(first, gone, texts)
    sums = np.concatenate(([0], np.cumsum(gone)))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(sums[first[1:]] - sums[first[:-1]], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())],
        ["doc_id", "n_words", "n_removed", "kept_sha256"],
    )


def _rewritten(ids, texts, first, gone, rows) -> pa.RecordBatch:
    texts = list(texts)
    left = kept(first, gone, texts)
    sums = np.concatenate(([0], np.cumsum(gone)))
    cut = sums[first[1:]] - sums[first[:-1]]
    text = pa.array([x if n else t for x, t, n in zip(left, texts, cut.tolist(), strict=True)], pa.binary()).cast(pa.string())
    text = pc.if_else(pc.is_null(rows.column("text")), pa.scalar(None, pa.string()), text)
    out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), text, rows.column("rest")], ["doc_id", "text", "rest"])
    return out.filter(pa.array((cut == 0) | (cut < np.diff(first))))


def removed(docs: DataFrame, found: DataFrame, verify: Verify, schema, result: Callable) -> DataFrame:
    """result(doc_ids, texts, first, gone, rows) of the documents with doc_id, in Arrow batches. found: doc_id, start, stop, mark; verify(words, first, row, start, stop, mark): which spans stand in the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, s, e, first, ids, rows in parts(batch):
                gone, column = np.zeros(len(s) + 1, np.int64), rows.column("spans")
                n = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
                if n.any():
                    flat = column.flatten()
                    row = np.repeat(np.arange(len(n)), n)
                    start, stop, mark = (np.asarray(flat.field(k)).astype(np.int64) for k in range(3))
                    room = stop <= np.diff(first)[row]  # rows that share a doc_id can be shorter
                    row, start, stop, mark = row[room], start[room], stop[room], mark[room]
                    ok = verify(W.hash_spans(part, s, e), first, row, start + first[row], stop + first[row], mark.view(np.uint64))
                    np.add.at(gone, (start + first[row])[ok], 1)
                    np.add.at(gone, (stop + first[row])[ok], -1)
                yield result(ids, (x.encode() if x else b"" for x in rows.column("text").to_pylist()), first, np.cumsum(gone)[:-1] > 0, rows)

    told = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "mark")).alias("spans"))
    return docs.join(told.hint("shuffle_hash"), "doc_id", "left").mapInArrow(run, schema)


def digest(docs: DataFrame, find: Callable[[DataFrame], DataFrame], verify: Verify) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; rows without doc_id keep all words."""
    docs = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    own = docs.where("doc_id IS NOT NULL")
    out = removed(own, find(own), verify, "doc_id long, n_words long, n_removed long, kept_sha256 string", _digest)
    words = F.expr(r"filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), x -> x != '')")
    loose = docs.where(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), words.alias("w"))
    return out.unionByName(loose.select("doc_id", F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.sha2(F.array_join("w", " "), 256).alias("kept_sha256")))


def clean(docs: DataFrame, find: Callable[[DataFrame], DataFrame], verify: Verify) -> DataFrame:
    """The rows of docs, with their own columns. A text that loses words has its other words, joined by one space; a row that loses all its words goes; all else is as it was."""
    packed, back = packed_rest(small_batches(docs), "doc_id long", "text string")
    own = packed.where("doc_id IS NOT NULL")
    out = removed(own, find(own.select("doc_id", "text")), verify, packed.schema, _rewritten)
    return out.select(*back).unionByName(docs.where("doc_id IS NULL"))
