"""Toxicity (op4): multiple-instance learning from document labels.

A sentence has the logit b + sum of the weights of its words and of their first
4 and 5 bytes (stems, for languages that inflect); a document is toxic if
any sentence is (noisy-or): 1 - product of (1 - sentence probability). Weights
of hashed features are fitted to the document labels alone, by gradient steps on
the likelihood of the noisy-or with a penalty, on at most TRAIN_ROWS labelled
documents and TRAIN_BYTES of text of each class, chosen by a hash of doc_id (whole
texts; one at least). A feature gets a weight if LEAST_DOCS training documents hold
it and its z-score between the classes is LEAST_Z; with few labels, where no
feature could get there, a quarter of the toxic documents and 0.6 of the largest
possible z-score are enough. The sentence probabilities then locate the offending
sentences (`sentences`).

Only text is an input of a score. Null and empty texts, and texts without
words, have the score of no sentence: 0. Labels that are null are not learned
from; of labels that repeat a doc_id, 1 counts. With labels of one class only,
every score is 0. doc_id may be null or repeat; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .session import small_batches

BITS = 18
TRAIN_ROWS = 2500  #: labelled documents of each class that are learned from, at most
TRAIN_BYTES = 24 << 20  #: bytes of their texts, at most
STEMS = (4, 5)  #: bytes of a word's beginning that are features too
LEAST_DOCS, LEAST_Z = 8, 6.0  #: training documents that hold a feature, and its z-score between the classes, for it to get a weight
STEPS, RATE, RIDGE = 120, 0.15, 1e-2

_END = np.zeros(256, np.int64)
_END[[0x0A, 0x21, 0x2E, 0x3F]] = 1


def instances(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks: first row; hashed words; first word of each sentence; row of each sentence; byte range of each sentence's words."""
    buf, offsets = W.buffers(column)
    for i, j in W.chunks(offsets):
        part, off = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        s, e, first = W.split(part, off, W.ALNUM)
        if not len(s):
            continue
        stops = (e, *(np.minimum(e, s + k) for k in STEMS))
        h = np.stack([((W.hash_spans(part, s, x, W.LOWER) + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64) for k, x in enumerate(stops)], 1)
        row = np.repeat(np.arange(j - i), np.diff(first))
        ends = np.cumsum(_END[part])[s]
        head = np.flatnonzero((np.diff(ends, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
        tail = np.append(head[1:], len(s)) - 1
        yield i, h, head, row[head], np.stack((s[head] - off[row[head]], e[tail] - off[row[head]]), 1)


class Model:
    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), bias

    def logits(self, h: np.ndarray, head: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.weight[h].sum(1, dtype=np.float64), head) + self.bias

    def scores(self, column: pa.Array) -> np.ndarray:
        none = np.zeros(len(column))
        for at, h, head, row, _ in instances(column):
            np.add.at(none, at + row, np.logaddexp(0, self.logits(h, head)))
        return -np.expm1(-none)


def learn(h: np.ndarray, head: np.ndarray, row: np.ndarray, label: np.ndarray) -> Model:
    """h: words; head: first word of each sentence; row: document of each sentence, ascending; label: by document."""
    n, size = len(label), 1 << BITS
    length = np.diff(np.append(head, len(h)))
    doc = np.repeat(row, length)
    pairs = np.unique(doc[:, None] * size + h)
    word, owner = pairs % size, pairs // size
    seen = np.bincount(word, minlength=size)
    bad = np.bincount(word, label[owner], minlength=size)
    pos, neg = label.sum(), n - label.sum()
    share = np.clip(seen / n, 1e-9, 1 - 1e-9)
    z = (bad / pos - (seen - bad) / neg) / np.sqrt(share * (1 - share) * (1 / pos + 1 / neg))
    keep = (seen >= min(LEAST_DOCS, max(2, pos // 4))) & (np.abs(z) >= min(LEAST_Z, 0.6 * np.sqrt(n)))  # a feature that parts the classes has z = sqrt(n)
    odds = np.log((bad + 0.5) / (pos + 1)) - np.log((seen - bad + 0.5) / (neg + 1))
    weight = np.where(keep, np.clip(odds, -1, 3), 0.0)
    bias, total = -6.0, weight.size
    m, v = np.zeros(total + 1), np.zeros(total + 1)
    prior = np.where(label > 0, n / (2 * pos), n / (2 * neg))
    for step in range(1, STEPS + 1):
        z = np.add.reduceat(weight[h].sum(1), head) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        none = np.bincount(row, np.logaddexp(0, z), minlength=n)
        any_ = np.maximum(-np.expm1(-none), 1e-9)
        pull = np.where(label > 0, -np.exp(-none) / any_, 1.0) * prior
        slope = pull[row] * p / n
        grad = np.append(np.bincount(h.ravel(), np.repeat(slope, length * h.shape[1]), minlength=size) * keep + RIDGE * weight / n, slope.sum()) * n
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1.0)
        weight, bias = weight - move[:-1], bias - move[-1]
    return Model(weight, float(bias))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Model:
    """From documents (doc_id, text) and labels (doc_id, toxic). At most 2 * train_rows doc_ids are broadcast; the driver gets the words of at most 2 * train_bytes of text."""
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    order = F.xxhash64("doc_id", F.lit(17))
    some = [one.where(F.col("y") == k).orderBy(order, "doc_id").limit(train_rows) for k in (0, 1)]
    texts = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sizes = texts.join(F.broadcast(some[0].unionByName(some[1])), "doc_id").groupBy("doc_id", "y").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"))
    taken, room = [], {0: train_bytes, 1: train_bytes}
    for x in sizes.orderBy(order, "doc_id").collect():  # at most 2 * train_rows rows
        if x["n"] <= room[x["y"]] or room[x["y"]] == train_bytes:
            room[x["y"]] -= x["n"]
            taken.append((x["doc_id"], x["y"]))
    chosen = F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long, y int"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.asarray(batch.column("y"))
            for at, h, head, row, _ in instances(batch.column("text")):
                length = np.diff(np.append(head, len(h)))
                edge = np.flatnonzero(np.diff(row, prepend=-1))
                for a, b in zip(edge.tolist(), np.append(edge[1:], len(row)).tolist(), strict=True):
                    lo, hi = int(head[a]), int(head[b]) if b < len(head) else len(h)
                    yield pa.RecordBatch.from_arrays([pa.array([int(y[at + row[a]])], pa.int32()), pa.array([h[lo:hi].astype("<i4").tobytes()], pa.binary()), pa.array([length[a:b].astype("<i4").tobytes()], pa.binary())], ["y", "words", "sizes"])

    rows = texts.join(chosen, "doc_id").select("text", "y").mapInArrow(words, "y int, words binary, sizes binary").toArrow()
    label = np.asarray(rows.column("y")).astype(np.float64)
    if not len(label) or label.min() == label.max():
        return Model(np.zeros(1 << BITS), -1e9)
    parts = [np.frombuffer(x.as_buffer(), "<i4") for x in rows.column("sizes")]
    sizes = np.concatenate(parts).astype(np.int64)
    h = np.concatenate([np.frombuffer(x.as_buffer(), "<i4") for x in rows.column("words")]).astype(np.int64).reshape(-1, 1 + len(STEMS))
    return learn(h, np.cumsum(sizes) - sizes, np.repeat(np.arange(len(label)), [len(x) for x in parts]), label)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.clip(shared.value.scores(batch.column("text")), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")


def sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, start, stop (bytes of the UTF-8 text), probability and text of each sentence of at least that probability."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for at, h, head, row, span in instances(texts):
                p = 1 / (1 + np.exp(-np.clip(shared.value.logits(h, head), -60, 60)))
                hit = np.flatnonzero(p >= least)
                raw = {r: texts[at + r].as_py().encode() for r in set(row[hit].tolist())}
                cut = [raw[r][a:b].decode(errors="replace") for r, (a, b) in zip(row[hit].tolist(), span[hit].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([ids[at + r] for r in row[hit].tolist()], pa.int64()), pa.array(span[hit, 0], pa.int64()), pa.array(span[hit, 1], pa.int64()), pa.array(p[hit]), pa.array(cut, pa.string())], ["doc_id", "start", "stop", "probability", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, stop long, probability double, text string")


def held_out(frame: DataFrame) -> DataFrame:
    return frame.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)))


def predict(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learned from the labels that are not held out."""
    model = fit(docs, held_out(labels).where("NOT held_out"), train_rows)
    return held_out(score(docs, model)).select("doc_id", "held_out", "score", "predicted")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
