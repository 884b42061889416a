"""Token-id output (op6): ids of all documents in doc_id order, with Elias-Fano document boundaries.

Documents are dealt to shards by ranges of doc_id and sorted. A shard is a
sequence of segments of about SEGMENT ids; one segment holds the concatenated
ids (2 bytes each while the vocabulary allows, else 4), and the ends and the
doc_ids of its documents as Elias-Fano sequences: low bits packed, high bits in unary, and
every 64th one's position, so an end is found without reading the others and
no 64-bit table is kept. Segments are binary columns of a Parquet table, which
is the only kind of file that every executor of a cluster can write and read.
An id's global position is its segment's base, from the sizes of the segments
before it, plus its place.

Texts are split where the tokenizer always splits (a single space or line break
between other characters, a letter beside a punctuation mark); each different piece is encoded once by the
tokenizers library and remembered. Strings of special tokens in a text are
ordinary text. Null texts are empty; every document ends with END. Rows with
null doc_id come first, rows that share a doc_id stand in order of their text;
extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .memo import Memo
from .session import partitions, size_of, small_batches, stage

END = 0  #: the id after each document
SEGMENT = 1 << 20  #: ids in a segment, but for a longer document
SAMPLE = 64
SHARD = 64 << 20  #: bytes of input in a shard, where that makes more shards than there are shuffle partitions

# --- Elias-Fano -------------------------------------------------------------


class EliasFano:
    """A non-decreasing sequence of n numbers up to `most`."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, most = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (most // n).bit_length() - 1) if n else 0
        low = ((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8)
        ones = (values >> bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """Position of the i-th one of the high bits."""
        at = int(np.frombuffer(self.samples, "<u4", 1, 4 * (i // SAMPLE))[0])
        left, byte = i % SAMPLE, at // 8
        word = self.high[byte] >> (at % 8) << (at % 8)
        while (k := word.bit_count()) <= left:
            left -= k
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        return 8 * byte + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        a, b = i * self.low_bits, (i + 1) * self.low_bits
        low = int.from_bytes(self.low[a // 8 : (b + 7) // 8], "little") >> (a % 8) & ((1 << self.low_bits) - 1)
        return (self.select(i) - i) << self.low_bits | low

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return ((ones - np.arange(self.n)) << self.low_bits) + (low << np.arange(self.low_bits)).sum(1, dtype=np.int64)


# --- pieces and their ids ---------------------------------------------------

#: What a byte can be, as bits.
_PLAIN, _WIDE, _LEAD, _LETTER, _MARK, _GAP, _C2, _C3 = (np.uint8(1 << k) for k in range(8))


def _kinds() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[0x21:0x7F] |= _PLAIN
    out[0x80:] |= _WIDE
    out[[0xC2, 0xE1, 0xE2, 0xE3]] |= _LEAD  # first bytes of characters among which some are white space
    out[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] |= _LETTER
    out[[x for x in range(0x21, 0x7F) if not chr(x).isalnum() and x != 0x27]] |= _MARK  # an apostrophe can start a piece of letters
    out[[0x0A, 0x20]] |= _GAP
    out[0xC2] |= _C2
    out[0xC3] |= _C3
    return out


_KINDS = _kinds()


def pieces(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of pieces that are encoded independently; every non-empty text starts one."""
    n = len(buf)
    first = np.zeros(n, bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    if n >= 3:
        k = _KINDS[buf]
        wide = k & _WIDE
        odd = np.zeros(n, np.uint8)  # the character that ends here is white space, perhaps
        odd[1:] |= (k[:-1] & _C2) >> np.uint8(5)
        odd[2:] |= k[:-2] & _LEAD
        solid = (k & _PLAIN) | wide
        before = solid * (odd * wide == 0)
        after = solid * (k & _LEAD == 0)
        first[1:-1] |= (k[1:-1] & _GAP > 0) & (before[:-2] > 0) & (after[2:] > 0) & ~first[1:-1] & ~first[2:]  # all three in one text
        line = np.flatnonzero(first[:-1] & (buf[:-1] == 0x0A))
        line = line[line > 0]
        line = line[(before[line - 1] > 0) & (after[line + 1] > 0) & ~np.isin(line, offsets)]
        letter = k & _LETTER  # last byte of a letter, of the basic alphabet or of Latin-1
        latin = np.flatnonzero(k[:-1] & _C3) + 1
        letter[latin[(buf[latin] != 0x97) & (buf[latin] != 0xB7)]] = _LETTER
        mark = (k & _MARK) >> np.uint8(1)
        first[1:] |= (letter[:-1] & mark[1:] | mark[:-1] & k[1:] & _LETTER) > 0
        first[line + 1] = True
    return np.flatnonzero(first)


class Encoder(Memo):
    """Ids of texts by a tokenizers file, END after each."""

    end, remember, slots = END, 1_000_000, 21

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        (self.line_break,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.forget()

    def cut(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return pieces(buf, offsets)

    def encoded(self, texts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        bare = [t[1:] if t[0] == " " else t for t in texts]
        plain = [i for i, t in enumerate(bare) if t.split() == [t]]
        rest = sorted(set(range(len(texts))) - set(plain))
        sizes, parts = [], []
        for k in range(0, len(plain), 4096):  # a line break between pieces without one is an id of its own
            ids = np.array(self.tokenizer.encode("\n".join([texts[i] for i in plain[k : k + 4096]]), add_special_tokens=False).ids, self.kind)
            cut = np.flatnonzero(ids == self.line_break)
            sizes.append(np.diff(np.concatenate(([-1], cut, [len(ids)]))) - 1)
            parts.append(ids[ids != self.line_break])
        found = [x.ids for x in self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)]
        sizes.append(np.array([len(x) for x in found], np.int64))
        parts.append(np.array([i for x in found for i in x], self.kind))
        return plain + rest, np.concatenate(sizes), np.concatenate(parts)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder; it is kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# --- the store --------------------------------------------------------------

_SEGMENT = "shard int, segment int, n_docs int, n_ids long, width int, n_null int, first_id long, id_bits int, id_low binary, id_high binary, id_samples binary, ids binary, low_bits int, low binary, high binary, samples binary"
_FAR = 1 << 62  #: a segment whose doc_ids span more keeps them as they are (id_bits -1)


def write(docs: DataFrame, path: str) -> DataFrame:
    """Encode docs (doc_id, text) and write the store to the shared folder. Gives the written table."""
    docs = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_head").asc_nulls_first()]  # the beginning of the text splits rows that share a doc_id, or have none
    spread = docs.withColumn("_head", F.substring("text", 1, 48)).repartitionByRange(max(partitions(docs.sparkSession), -(-size_of(docs) // SHARD)), *order).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment = TaskContext.get().partitionId(), 0
        ids, sizes, names, nulls, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            size, flat = np.concatenate(sizes), np.concatenate(ids)
            ef, n_null = EliasFano.of(np.cumsum(size)), int(np.concatenate(nulls).sum())
            known = np.concatenate(names)[n_null:].astype(np.int64)  # ascending; rows without doc_id come first
            first_id = int(known[0]) if len(known) else 0
            if len(known) and int(known[-1]) - first_id >= _FAR:
                id_bits, *packed = -1, known.astype("<i8").tobytes(), b"", b""
            else:
                x = EliasFano.of(known - first_id)
                id_bits, *packed = x.low_bits, x.low, x.high, x.samples
            row = [shard, segment, len(size), len(flat), flat.itemsize, n_null, first_id, id_bits, *packed, flat.tobytes(), ef.low_bits, ef.low, ef.high, ef.samples]
            kinds = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in _SEGMENT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [x.split()[0] for x in _SEGMENT.split(", ")])

        for batch in batches:
            buf, offsets = W.buffers(batch.column("text"))
            name = batch.column("doc_id")
            null, name = np.asarray(name.is_null()), np.asarray(name.fill_null(0))
            for i, j in W.chunks(offsets, 2 << 20):
                flat, size = encoder(path).ids(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids.append(flat)
                sizes.append(size)
                names.append(name[i:j])
                nulls.append(null[i:j])
                held += len(flat)
                if held >= SEGMENT:
                    yield flush()
                    ids, sizes, names, nulls, held, segment = [], [], [], [], 0, segment + 1
        if sizes:
            yield flush()

    return stage(spread.mapInArrow(run, _SEGMENT), "tokens")


def bases(store: DataFrame) -> DataFrame:
    """shard, segment, base: ids before each segment. Two levels: shards in one small window, segments within their shard."""
    size = store.select("shard", "segment", "n_ids")
    total = size.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    shard = total.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("s"))
    return size.withColumn("i", F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).join(shard, "shard").select("shard", "segment", (F.col("s") + F.col("i")).alias("base"))


def doc_ids(segment: dict) -> pa.Array:
    """The doc_ids of a segment, null for rows without one."""
    n = segment["n_docs"] - segment["n_null"]
    if segment["id_bits"] < 0:
        known = np.frombuffer(segment["id_low"], "<i8")
    else:
        known = EliasFano(n, segment["id_bits"], segment["id_low"], segment["id_high"], segment["id_samples"]).all() + segment["first_id"]
    return pa.concat_arrays([pa.nulls(segment["n_null"], pa.int64()), pa.array(known, pa.int64())])


def document(segment: dict, i: int) -> np.ndarray:
    """The ids of the i-th document of a segment, by two selects: no other boundary is read."""
    ends = EliasFano(segment["n_docs"], segment["low_bits"], segment["low"], segment["high"], segment["samples"])
    start = ends[i - 1] if i else 0
    return np.frombuffer(segment["ids"], f"<u{segment['width']}", ends[i] - start, start * segment["width"])


def ids_of(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and ids (array<int>) of the wanted doc_ids: segments are found by their range of doc_ids, documents by select."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                names = np.asarray(doc_ids(x).slice(x["n_null"]))
                for w in sorted(set(x["wanted"])):
                    a, b = np.searchsorted(names, [w, w + 1])
                    found = [document(x, x["n_null"] + i).tolist() for i in range(int(a), int(b))]
                    yield pa.RecordBatch.from_arrays([pa.array([w] * len(found), pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "ids"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(x["shard"], x["segment"], x["first_id"], doc_ids(x)[-1].as_py()) for x in batch.to_pylist() if x["n_docs"] > x["n_null"]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["shard", "segment", "lo", "hi"])

    spans = store.mapInArrow(last, "shard int, segment int, lo long, hi long")
    hits = wanted.select(F.col("doc_id").cast("long").alias("w")).where("w IS NOT NULL").join(spans, F.col("w").between(F.col("lo"), F.col("hi")))
    asked = hits.groupBy("shard", "segment").agg(F.collect_set("w").alias("wanted"))
    return store.join(asked, ["shard", "segment"]).mapInArrow(run, "doc_id long, ids array<int>")


def read(store: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written segments."""
    base = stage(bases(store), "bases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ends = EliasFano(x["n_docs"], x["low_bits"], x["low"], x["high"], x["samples"]).all()
                start = np.concatenate(([0], ends[:-1]))
                wide = np.frombuffer(x["ids"], f"<u{x['width']}").astype("<u4")
                raw = memoryview(wide).cast("B")
                names = doc_ids(x)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(start + x["base"]), pa.array(ends - start), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    joined = store.join(base, ["shard", "segment"])
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary()))
