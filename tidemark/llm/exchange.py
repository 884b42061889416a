"""Rows of numpy arrays dealt to buckets as packed blocks.

A map task sorts what it found by bucket and sends one Spark row per bucket,
with its columns as little-endian bytes. Hundreds of thousands of hashes then
cost one row in the JVM, while the hash still decides where they meet. The
number of buckets, and of the tasks that read them, grows with the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W
from .session import partitions, size_of

BUCKET = 32 << 20  #: bytes of input for each bucket
HOLD = 1 << 18  #: rows that a map task holds before it sends them


def pack(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per bucket: bucket, and a binary column for each array. Arrays of two dimensions give their rows."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    first = np.flatnonzero(np.diff(sorted_, prepend=-1)) if len(order) else np.zeros(0, np.int64)
    out = [pa.array(sorted_[first], pa.int32())]
    for values in columns.values():
        values = np.ascontiguousarray(values[order])
        offsets = np.append(first, len(order)) * (values.itemsize * (values.shape[1] if values.ndim == 2 else 1))
        out.append(pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary()))
    return pa.RecordBatch.from_arrays(out, ["bucket", *columns])


def beside(parts: list[pa.RecordBatch], names: list[str]) -> pa.RecordBatch:
    """Packed batches of different columns under each other; columns that a batch lacks are empty."""
    rows = [pa.RecordBatch.from_arrays([p.column(c) if c in p.schema.names else pa.array([b""] * len(p), pa.binary()) for c in names], names) for p in parts]
    return pa.Table.from_batches(rows).combine_chunks().to_batches()[0] if any(map(len, rows)) else rows[0]


def unpack(table: pa.Table, name: str, kind: str, width: int = 0) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]
    out = np.concatenate(parts) if parts else np.zeros(0, kind)
    return out.reshape(-1, width) if width else out


def buckets(df: DataFrame) -> int:
    """Twice the shuffle partitions, and more where these would get over BUCKET bytes of the input each."""
    return max(2 * partitions(df.sparkSession), -(-size_of(df) // BUCKET))


def by_bucket(packed: DataFrame, work: Callable[[pa.Table], pa.Table | Iterator[pa.RecordBatch]], schema: str, n: int = 0) -> DataFrame:
    """All blocks of a bucket together; n: how many buckets. The bucket is a hash of a value that each map task sends once, so its size is even."""
    if n > 2 * partitions(packed.sparkSession):
        packed = packed.repartition(n // 2, "bucket")
    return packed.groupBy("bucket").applyInArrow(work, schema)


def to_bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (h % np.uint64(n)).astype(np.int32)


def of_doc(doc: np.ndarray, n: int) -> np.ndarray:
    return to_bucket(W.mix(doc.astype(np.int64).view(np.uint64)), n)


def heads(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def classes(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of rows by keys and document; in it, for each row the number of its class, and the smallest document of each class."""
    order = np.lexsort([doc, *reversed(keys)])
    new = heads(*(k[order] for k in keys))
    return order, np.cumsum(new) - 1, doc[order][new]


def held_elsewhere(frame: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], n: int) -> DataFrame:
    """(doc_id, keys): for each document the keys (array of long) that another document has too. keys_of gives keys and documents of a batch.

    A map task settles keys that it sees in several documents, and tells their
    bucket so in one row; a key in a third of all documents is one row per task.
    """
    names = ["bucket", "token", "doc", "known", "by"]

    def tally(key: np.ndarray, doc: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys and documents, and whether another document has the key; rows with several say so for their key alone."""
        order = np.lexsort([doc, several, key])
        key, doc, several = key[order], doc[order], several[order]
        cls = np.cumsum(heads(key)) - 1
        pair = heads(key, several, doc)
        many = np.bincount(cls, pair & ~several) + 2 * np.bincount(cls, several) > 1
        own = pair & ~several
        return key[own], doc[own], many[cls[own]]

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        key, doc, many = tally(key, doc, np.zeros(len(key), bool))
        one = ~many | heads(key)
        a = pack(to_bucket(key[one], n), {"token": key[one], "doc": doc[one], "several": many[one].astype(np.uint8)})
        b = pack(of_doc(doc[many], n), {"known": key[many], "by": doc[many]})
        return beside([a, b], [*names, "several"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for key, doc in keys_of(batch):
                held.append((key, doc))
                size += len(key)
                if size >= HOLD:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    def meet(table: pa.Table) -> pa.Table:
        key, doc, many = tally(unpack(table, "token", "<u8"), unpack(table, "doc", "<i8"), unpack(table, "several", "u1") > 0)
        key, doc = np.concatenate((key[many], unpack(table, "known", "<u8"))), np.concatenate((doc[many], unpack(table, "by", "<i8")))
        return pa.Table.from_batches([pack(of_doc(doc, n), {"known": key, "by": doc})])

    def listed(table: pa.Table) -> pa.Table:
        key, doc = unpack(table, "known", "<u8"), unpack(table, "by", "<i8")
        order = np.lexsort([key, doc])
        key, doc = key[order], doc[order]
        once = heads(key, doc)
        key, doc = key[once], doc[once]
        first = np.flatnonzero(heads(doc))
        return pa.table({"doc_id": pa.array(doc[first], pa.int64()), "keys": pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)), pa.int32()), pa.array(key.view(np.int64)))})

    sent = frame.mapInArrow(send, "bucket int, token binary, doc binary, known binary, by binary, several binary")
    return by_bucket(by_bucket(sent, meet, "bucket int, known binary, by binary", n), listed, "doc_id long, keys array<long>", n)
