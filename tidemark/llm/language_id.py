"""Language ID (op3): which languages a text mixes, and in which shares.

Each language is a distribution over hashed letter trigrams, counted over all
labelled training texts. For each document, expectation-maximisation finds the
shares of the languages that make its trigrams likeliest. Languages then leave
one by one, smallest share first, while the penalised likelihood gains: a
language has to be worth PENALTY * log(trigrams) / 2, with the likelihood
divided by 3 because neighbouring trigrams overlap. The prediction is the
language with the largest share, the score its share.

A text that is null or has no letter is `und` with score 0. Training rows with
null lang or null text are not learned from. Equal shares go to the language
that comes first in order. With no training row, every text is `und`. Only the
text is an input of a prediction. doc_id may be null or repeat; extra columns
are ignored by `predict` and kept by `annotate`, but for those named as its results.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import words as W
from .session import plain_names, small_batches

GRAMS = 4096  #: hashed trigrams
ROWS = 64  #: documents whose counts are held as one matrix
PENALTY = 8.0
STEPS = 12

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _letters(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters; all else of ASCII becomes a blank."""
    out = np.where(_LETTER[buf], W.LOWER[buf], np.uint8(0x20))
    upper = (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97) & (out[:-1] == 0xC3)
    out[1:][upper] += 0x20
    return out


def matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """First row, and the trigram counts of up to ROWS texts."""
    buf, offsets = W.buffers(column)
    for i, j in W.chunks(offsets):
        off = offsets[i : j + 1] - offsets[i]
        x = _letters(buf[offsets[i] : offsets[j]])
        if len(x) >= 3:
            blank = x == 0x20
            gram = x[:-2].astype(np.uint32) * np.uint32(0x9E3779B1) + x[1:-1].astype(np.uint32) * np.uint32(0x85EBCA77) + x[2:].astype(np.uint32) * np.uint32(0xC2B2AE3D)
            gram = ((gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20)).astype(np.int64)
            good = ~(blank[1:-1] & (blank[:-2] | blank[2:]))
            for e in (1, 2):
                cut = off[1:] - e
                good[cut[(cut >= 0) & (cut < len(good))]] = False
            at = np.flatnonzero(good)
            gram = gram[at]
        else:
            at = gram = np.zeros(0, np.int64)
        for a in range(0, j - i, ROWS):
            b = min(a + ROWS, j - i)
            lo, hi = np.searchsorted(at, [off[a], off[b]])
            row = np.searchsorted(off[a : b + 1], at[lo:hi], "right") - 1
            yield i + a, np.bincount(row * GRAMS + gram[lo:hi], minlength=(b - a) * GRAMS).reshape(b - a, GRAMS)


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether a text has a letter of any script."""
    buf, offsets = W.buffers(column)
    ascii_letter = _LETTER[buf] & (buf < 0x80)
    sums = np.concatenate(([0], np.cumsum(ascii_letter)))
    out = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[i] = any(unicodedata.category(c)[0] == "L" for c in column[i].as_py() or "")
    return out


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + 0.5
        self.p = smooth / smooth.sum(1, keepdims=True)

    def _em(self, c: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        total = np.maximum(c.sum(1, keepdims=True), 1)
        for _ in range(steps):
            share = share * ((c / (share @ self.p + 1e-300)) @ self.p.T) / total
        return share, (c * np.log(share @ self.p + 1e-300)).sum(1)

    def shares(self, c: np.ndarray) -> np.ndarray:
        """Rows of shares by language; a left out language has 0."""
        n, k = len(c), len(self.langs)
        used = c.any(0)
        c = c[:, used].astype(np.float64)
        whole, self.p = self.p, np.ascontiguousarray(self.p[:, used])
        try:
            share, fit = self._em(c, np.full((n, k), 1 / k), STEPS)
            more = c.any(1)
            cost = PENALTY * np.log(np.maximum(c.sum(1), 2)) / 2
            for _ in range(k - 1):
                open_ = np.flatnonzero(more & ((share > 0).sum(1) > 1))
                if not len(open_):
                    break
                s = share[open_]
                drop = np.where(s > 0, s, 2).argmin(1)
                less = s.copy()
                less[np.arange(len(open_)), drop] = 0
                less, new = self._em(c[open_], less / np.maximum(less.sum(1, keepdims=True), 1e-300), 6)
                better = (fit[open_] - new) / 3 < cost[open_]
                share[open_[better]], fit[open_[better]] = less[better], new[better]
                more[open_[~better]] = False
            share[~c.any(1)] = 1 / k  # nothing to tell them apart
            return share
        finally:
            self.p = whole


def fit(train: DataFrame) -> Model:
    """From rows (text, lang). The driver gets one number for each language and trigram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for at, c in matrices(batch.column("text")):
                mine = langs[at : at + len(c)]
                for lang in set(mine):
                    sums[lang] = sums.get(lang, 0) + c[mine == lang].sum(0)
        for lang, c in sums.items():
            gram = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram, pa.int32()), pa.array(c[gram], pa.int64())], ["lang", "gram", "n"])

    rows = small_batches(train).where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    table = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    number = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((len(langs), GRAMS))
    counts[[number[x] for x in table.column("lang").to_pylist()], np.asarray(table.column("gram"))] = np.asarray(table.column("n"))
    return Model(langs, counts)


def _predicted(batch: pa.RecordBatch, model: Model) -> list[pa.Array]:
    text = batch.column("text")
    share = np.zeros((len(text), len(model.langs) + 1))
    if model.langs:
        for at, c in matrices(text):
            share[at : at + len(c), :-1] = model.shares(c)
    best = share.argmax(1)
    known = has_letter(text) & bool(model.langs)
    score = np.where(known, np.clip(share.max(1), 0, 1), 0.0)
    return [pa.array([model.langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)], pa.string()), pa.array(score)]


def annotate(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score; columns of docs with these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    named, docs = [*docs.columns, "lang_pred", "score"], plain_names(docs, "text")
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *_predicted(batch, shared.value)], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])).toDF(*named)


def mixtures(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the language set with its shares: langs array<struct<lang, share>>, largest share first."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, out = shared.value, [[] for _ in range(len(batch))]
            known = has_letter(batch.column("text"))
            for at, c in matrices(batch.column("text")) if m.langs else ():
                for i, s in enumerate(m.shares(c), at):
                    out[i] = [{"lang": m.langs[k], "share": float(s[k])} for k in np.argsort(-s, kind="stable").tolist() if s[k] > 0 and known[i]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))], ["doc_id", "langs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, langs array<struct<lang: string, share: double>>")


def held_out(docs: DataFrame, mod: int = 4, rest: int = 2) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False)))


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    docs = held_out(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "lang"))
    model = fit(docs.where("NOT held_out"))
    return annotate(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(spark.read.parquet(f"{sf_dir}/documents.parquet"))
