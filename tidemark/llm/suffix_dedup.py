"""Suffix-array dedup (op2): passages of 32 words or more that stand in an earlier document are removed.

A sparse suffix array over all documents. Of all suffixes only those are
retained that start at a minimiser (the least hash of 12-word prefixes in a
window of 32 words): every passage of 32 words holds one, and equal passages
hold it at the same place.

1. `sampled`: suffix positions, and the hash of the 12 words that they start
   with. Prefixes that one document alone has are dropped.
2. The others go to the bucket of their prefix with up to 32 words to the right
   and 20 to the left, which is all that a passage of 32 words around the
   position can hold. A map task sends equal contexts once.
3. `judged`, in each bucket: suffixes are sorted by their words; comparing
   neighbours gives the length of their common prefix, the match extended to
   the right. The same for the reversed words before the positions, extended
   to the left. Suffixes with common prefix 32 - a and common left context a
   share the passage of 32 words that starts a words before them; it is
   repeated in all documents but the smallest. Neighbouring passages merge.

A word goes if a passage of 32 words that starts in a document with a smaller
doc_id covers it; matches are judged on the input. Null and empty texts have no
words; rows without doc_id lose nothing; rows that share a doc_id are one
document; extra columns are ignored by the digest and kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import passages
from . import words as W
from .exchange import beside, buckets, by_bucket, classes, held_elsewhere, of_doc, pack, to_bucket, unpack

LEAST, PREFIX = 32, 12
_HELD = 40_000  #: contexts that a map task holds before it sends them


def sampled(words: np.ndarray, first: np.ndarray, least: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Retained suffixes of the texts of a chunk: word positions, texts, hashes of their first `prefix` words."""
    at = W.starts_of(first, least)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    hashes = W.runs(words, prefix)
    p = np.unique(W.sliding_argmin(hashes, least - prefix + 1)[at])
    return p, np.searchsorted(first, p, "right") - 1, hashes[p]


def contexts(words: np.ndarray, first: np.ndarray, p: np.ndarray, row: np.ndarray, least: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words to the right of each position (0 past the end of its text), words to the left from near to far, and how many of each there are."""
    right, left = np.minimum(first[row + 1] - p, least), np.minimum(p - first[row], least - prefix)
    some = words | np.uint64(1)  # 0 stands for no word
    i = np.arange(least)
    a = np.where(i < right[:, None], some[np.minimum(p[:, None] + i, len(words) - 1)], np.uint64(0))
    i = np.arange(least - prefix)
    b = np.where(i < left[:, None], some[np.maximum(p[:, None] - 1 - i, 0)], np.uint64(0))
    return a, b, right, left


def ordered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of words, and for each row in it the words that it has in common with the one before (-1 for the first)."""
    if not rows.shape[1]:
        return np.arange(len(rows)), np.where(np.arange(len(rows)) > 0, 0, -1)
    wide = np.ascontiguousarray(rows.astype(">u8")).view(f"V{8 * rows.shape[1]}").ravel()
    order = np.argsort(wide, kind="stable")
    x = rows[order]
    differ = x[1:] != x[:-1]
    common = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, np.concatenate(([-1], common)) if len(rows) else np.zeros(0, np.int64)


def _classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of classes of rows that agree in their first `depth` words."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def judged(a: np.ndarray, b: np.ndarray, right: np.ndarray, left: np.ndarray, doc: np.ndarray, least: int, prefix: int) -> np.ndarray:
    """For each suffix and each k, whether a smaller document has the passage of `least` words that starts k words before it."""
    out = np.zeros((len(doc), least - prefix + 1), bool)
    by_right, by_left = ordered(a), ordered(b)
    for k in range(least - prefix + 1):
        at = np.flatnonzero((left >= k) & (right >= least - k))
        if len(at) > 1:
            order, cls, lowest = classes([_classes(*by_right, least - k)[at], _classes(*by_left, k)[at]], doc[at])
            out[at[order], k] = doc[at][order] > lowest[cls]
    return out


def _merged(hit: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring passages: row, and first and last word from the suffix's position."""
    flat = np.zeros((hit.shape[0], hit.shape[1] + 2), np.int8)
    flat[:, 1:-1] = hit
    step = np.diff(flat, axis=1)
    row, lo = np.nonzero(step == 1)
    _, hi = np.nonzero(step == -1)  # passages lo .. hi - 1 words before the position
    return row, 1 - hi, least - lo


def find(docs: DataFrame, least: int = LEAST, prefix: int = PREFIX) -> DataFrame:
    """Repeated passages of docs (doc_id, text): doc_id, start, stop, mark."""
    n = buckets(docs)
    row_of = {"doc": "<i8", "at": "<i4"}
    names = ["bucket", "right", "left", *row_of, "sdoc", "start", "stop", "mark"]

    def keys_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part, s, e, first, ids, _ in passages.parts(batch):
            _, row, h = sampled(W.hash_spans(part, s, e), first, least, prefix)
            yield h, ids[row]

    def flush(held: list[tuple]) -> pa.RecordBatch:
        h, whole, a, b, doc, at, right, left, mark = (np.concatenate(x) for x in zip(*held, strict=True))
        order, cls, lowest = classes([h, whole], doc)
        later = order[doc[order] > lowest[cls]]  # all of the context is repeated
        one = order[doc[order] == lowest[cls]]
        x = pack(to_bucket(h[one], n), {"right": a[one], "left": b[one], "doc": doc[one], "at": at[one].astype("<i4")})
        y = pack(of_doc(doc[later], n), {"sdoc": doc[later], "start": (at[later] - left[later]).astype("<i4"), "stop": (at[later] + right[later]).astype("<i4"), "mark": mark[later]})
        return beside([x, y], names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part, s, e, first, ids, rows in passages.parts(batch):
                words = W.hash_spans(part, s, e)
                p, row, h = sampled(words, first, least, prefix)
                column = rows.column("keys")
                tag = W.mix(np.arange(len(rows)).astype(np.uint64) + np.uint64(7))
                asked = np.asarray(column.flatten()).astype(np.int64).view(np.uint64) ^ np.repeat(tag, np.asarray(pc.fill_null(pc.list_value_length(column), 0)))
                keep = np.isin(h ^ tag[row], asked)
                p, row, h = p[keep], row[keep], h[keep]
                for i in range(0, len(p), _HELD):  # a chunk of a very long text has many
                    q, r = p[i : i + _HELD], row[i : i + _HELD]
                    a, b, right, left = contexts(words, first, q, r, least, prefix)
                    mark, twin = (W.spans(words | np.uint64(1), q - left, left + right, lane) for lane in W.LANES)
                    full = W.mix(mark + W.mix(twin + left.astype(np.uint64)))
                    held.append((h[i : i + _HELD], full, a, b, ids[r], q - first[r], right, left, mark))
                    size += len(q)
                    if size >= _HELD:
                        yield flush(held)
                        held, size = [], 0
        if size:
            yield flush(held)

    def judge(table: pa.Table) -> pa.Table:
        out = [passages.spans_of(*(unpack(table, c, k) for c, k in (("sdoc", "<i8"), ("start", "<i4"), ("stop", "<i4"), ("mark", "<u8"))))]
        a, b = unpack(table, "right", "<u8", least), unpack(table, "left", "<u8", least - prefix)
        doc, at = (unpack(table, c, k) for c, k in row_of.items())
        if len(doc):
            hit = judged(a, b, (a != 0).sum(1), (b != 0).sum(1), doc, least, prefix)
            row, lo, hi = _merged(hit, least)
            line = np.concatenate((b[:, ::-1], a), 1)  # the words around each position
            width, zero = line.shape[1], least - prefix
            mark = W.spans(line.ravel(), row * width + zero + lo, hi - lo) if len(row) else np.zeros(0, np.uint64)
            out.append(passages.spans_of(doc[row], at[row] + lo, at[row] + hi, mark))
        return pa.Table.from_batches(out)

    shared = held_elsewhere(docs.select("doc_id", "text"), keys_of, n)
    sent = docs.join(shared.hint("shuffle_hash"), "doc_id").mapInArrow(send, ", ".join(f"{c} {'int' if c == 'bucket' else 'binary'}" for c in names))
    return by_bucket(sent, judge, passages.FIELDS, n)


def verify(words: np.ndarray, first: np.ndarray, row: np.ndarray, start: np.ndarray, stop: np.ndarray, mark: np.ndarray) -> np.ndarray:
    return W.spans(words | np.uint64(1), start, stop - start) == mark


def digest(docs: DataFrame, least: int = LEAST, prefix: int = PREFIX) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (lowercase hex; kept words joined by one space)."""
    return passages.digest(docs, lambda own: find(own, least, prefix), verify)


def clean(docs: DataFrame, least: int = LEAST, prefix: int = PREFIX) -> DataFrame:
    """The rows of docs, with their own columns. A text that loses words has its other words, joined by one space; a row that loses all its words goes; all else is as it was."""
    return passages.clean(docs, lambda own: find(own, least, prefix), verify)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
