"""SentencePiece encoding and decoding (op1) of whole text columns, without a Python step per character.

Words of equal length form one matrix and advance together: at each position,
the hashes of the substrings that end there are looked up in the sorted piece
keys, and a vectorised maximum keeps the best piece as back pointer; the ids
follow from the back pointers.

What is maximal depends on the model. For a unigram model it is the sum of
scores (Viterbi). For a BPE model the sum of scores does not give the ids that
the model defines, so the maximum is over the pieces that may follow: a prefix
has one BPE segmentation, its last piece is the one that does not merge with
the piece before it at any time, and whether two pieces merge is found by
undoing their merges from the last to the first (`Vocabulary.apart`). The ids
are those of the sentencepiece library in both cases.

Texts are cut beforehand wherever no piece spans the two bytes, which cannot
change the ids, and the ids of each different word are remembered. Characters
without piece become byte pieces, or the unknown id where the model has none.

Null and empty texts have no ids. Every row is encoded by itself: doc_id may be
null or repeat; extra columns are ignored. Only models that leave text as it is
(identity normalizer, spaces kept, dummy prefix) are accepted.
"""

from __future__ import annotations

import functools
import hashlib
import weakref
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .memo import Memo
from .session import small_batches

SPACE = "▁"
_BASE = 0x9E3779B97F4A7C15
_FILTER = 20
LONG = 96  #: longer words advance alone


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, modulo 2**64. Substrings of at most a piece's length are hashed by them, and no two pieces have one hash."""
    both = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        row = np.full(n, x, np.uint64)
        row[0] = 1
        both.append(np.cumprod(row))
    return tuple(both)


def _up(n: int) -> np.ndarray:
    return _powers(n + 1)[0]


class Vocabulary:
    """Piece keys, costs and merges of a model file; of fixed size, so that it can be broadcast."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            m = proto.ModelProto.FromString(f.read())
        n, t = m.normalizer_spec, m.trainer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or t.treat_whitespace_as_suffix or t.model_type not in (1, 2):
            raise ValueError("only BPE and unigram models that leave text as it is are supported")
        self.bpe, self.size, self.unknown = t.model_type == 2, len(m.pieces), next(i for i, p in enumerate(m.pieces) if p.type == 2)
        self.bytes_ = np.full(256, self.unknown)
        self.surface = []
        names: dict[str, int] = {}
        for i, p in enumerate(m.pieces):
            self.surface.append(p.piece.replace(SPACE, " ").encode() if p.type in (1, 4, 5) else b"")
            if p.type in (1, 4):
                names[p.piece] = i
            elif p.type == 6:
                self.bytes_[int(p.piece[3:5], 16)] = i
                self.surface[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == 2:
                self.surface[i] = " ⁇ ".encode()
        self.fallback = self.bytes_.min() != self.unknown
        self.most = max(map(len, names))
        texts = list(names)
        ids = np.array([names[x] for x in texts])
        hashes = np.array([self.hash_of(x) for x in texts], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], ids[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.filter = np.zeros(1 << _FILTER, bool)
        self.filter[(W.mix(self.keys) >> np.uint64(64 - _FILTER)).astype(np.int64)] = True
        self.hash = np.zeros(self.size, np.uint64)
        self.length = np.zeros(self.size, np.int64)
        self.hash[ids], self.length[ids] = hashes, [len(x) for x in texts]
        self.score = np.array([p.score for p in m.pieces], np.float64)
        self.lowest = self.score[ids].min()
        self.cost = np.where(self.length > 1, -self.score, -np.inf)  # when a piece is made; single characters are there from the start
        self.left, self.right = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        self.made = self.length == 1
        if self.bpe:
            self._merges(names)
        self.pair_key, self.pair_ok = np.zeros(1 << 18, np.int64) - 1, np.zeros(1 << 18, bool)
        self.joined = np.zeros((256, 256), bool)  # bytes that stand side by side in a piece
        for x in texts:
            for raw in {x.encode(), x.replace(SPACE, " ").encode()}:
                b = np.frombuffer(raw, np.uint8)
                self.joined[b[:-1], b[1:]] = True
        if any(SPACE * 2 in x for x in texts):  # a space beside the character that stands for it
            self.joined[0x81, 0x20] = self.joined[0x20, 0xE2] = True
        self.joined[:, 0x80:0xC0] = True  # never inside a character
        self.joined = self.joined.ravel()
        sizes = np.array([len(x) for x in self.surface])
        self.at, self.flat = np.concatenate(([0], np.cumsum(sizes))), np.frombuffer(b"".join(self.surface), np.uint8)

    @staticmethod
    def hash_of(text: str) -> int:
        out, power = 0, 1
        for c in text:
            out += (ord(c) + 0x10001) * power
            power = power * _BASE & (1 << 64) - 1
        return out & (1 << 64) - 1

    def _merges(self, names: dict[str, int]) -> None:
        """The last merge of each piece, when its own text is encoded."""
        score = self.score
        for text, i in names.items():
            if len(text) < 2:
                continue
            parts = list(text)
            while len(parts) > 1:
                found = [(-score[names[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in names]
                if not found:
                    break
                _, k = min(found)
                if len(parts) == 2 and parts[0] in names and parts[1] in names:
                    self.left[i], self.right[i], self.made[i] = names[parts[0]], names[parts[1]], True
                parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 where there is none."""
        out = np.full(len(h), -1)
        maybe = np.flatnonzero(self.filter[(W.mix(h) >> np.uint64(64 - _FILTER)).astype(np.int64)])
        some = h[maybe]
        at = np.searchsorted(self.keys, some)
        at[at == len(self.keys)] = 0
        out[maybe] = np.where(self.keys[at] == some, self.ids[at], -1)
        return out

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit, tie = np.full(len(a), np.inf), np.ones(len(a), bool)
        while len(live):
            z = self.find(self.hash[a] + self.hash[b] * _up(2 * self.most)[self.length[a]])
            made = np.where(z >= 0, -self.score[z], np.inf)
            bad = (z >= 0) & ((made < limit) | tie & (made == limit) | np.isinf(limit))
            out[live[bad]] = False
            undo_a = self.cost[a] > self.cost[b]  # the later of the two is undone; of equal ones the right one was made later
            last = np.where(undo_a, self.cost[a], self.cost[b])
            keep = ~bad & ~np.isinf(last)
            a, b, limit, tie = np.where(undo_a, self.right[a], a)[keep], np.where(undo_a, b, self.left[b])[keep], last[keep], ~undo_a[keep]
            live = live[keep]
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the neighbours a, b as they are. Answers are kept in a table of fixed size."""
        key = a * self.size + b
        slot = (W.mix(key.astype(np.uint64)) >> np.uint64(46)).astype(np.int64)
        out = self.pair_ok[slot]
        miss = np.flatnonzero(self.pair_key[slot] != key)
        if len(miss):
            new, at = np.unique(key[miss], return_inverse=True)
            ok = self._apart(new // self.size, new % self.size)
            out[miss] = ok[at]
            s = (W.mix(new.astype(np.uint64)) >> np.uint64(46)).astype(np.int64)
            self.pair_key[s] = new
            self.pair_ok[s] = ok
            wrong = self.pair_key[s] != new  # two new pairs in one slot: the last stays
            self.pair_ok[s[~wrong]] = ok[~wrong]
        return out

    def paths(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Back pointers of words of equal length: piece (-1: a character without piece) and its length, by end position."""
        n, length = codes.shape
        sums = np.zeros((length + 1, n), np.uint64)
        up, down = (x[: length + 2] for x in _powers(1 << (length + 1).bit_length()))
        sums[1:] = np.cumsum((codes.T.astype(np.uint64) + np.uint64(0x10001)) * up[:length, None], 0)
        last, size = np.full((length + 1, n), -1), np.ones((length + 1, n), np.int64)
        best = np.zeros((length + 1, n))
        for i in range(1, length + 1):
            value = np.full(n, -np.inf)
            for k in range(1, min(i, self.most) + 1):
                piece = self.find((sums[i] - sums[i - k]) * down[i - k])
                hit = np.flatnonzero(piece >= 0)
                found = piece[hit]
                if self.bpe:
                    hit, found = hit[self.made[found]], found[self.made[found]]
                    before = last[i - k, hit]
                    fits = np.ones(len(hit), bool)
                    tied = before >= 0
                    fits[tied] = self.apart(before[tied], found[tied])
                    hit, found = hit[fits], found[fits]
                    gain = np.full(len(hit), float(k))
                else:
                    gain = best[i - k, hit] + self.score[found]
                more = gain > value[hit]
                at = hit[more]
                value[at], last[i, at], size[i, at] = gain[more], found[more], k
                if k == 1:
                    none = np.flatnonzero(piece < 0)  # a character without piece stands alone
                    value[none] = -1.0 if self.bpe else best[i - 1, none] + self.lowest - 10
            best[i] = value
        return last, size

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        sizes, flat = np.zeros(len(words), np.int64), [np.zeros(0, np.int64)] * len(words)
        codes = [np.frombuffer(x.encode("utf-32-le"), "<u4") for x in words]
        length = np.array([len(x) for x in codes])
        for n in np.unique(length).tolist():
            group = np.flatnonzero(length == n)
            step = max(1, (1 << 20) // (n + 1)) if n <= LONG else 1
            for at in range(0, len(group), step):
                some = group[at : at + step]
                m = np.stack([codes[i] for i in some])
                last, size = self.paths(m)
                rows, pos = np.arange(len(some)), np.full(len(some), n)
                out = []  # from the last piece to the first
                while len(rows):
                    piece, k = last[pos, rows], size[pos, rows]
                    out.append((rows, piece, np.where(piece < 0, m[rows, pos - 1], 0)))
                    pos = pos - k
                    rows, pos = rows[pos > 0], pos[pos > 0]
                row = np.concatenate([x[0] for x in out])
                order = np.lexsort((-np.repeat(np.arange(len(out)), [len(x[0]) for x in out]), row))
                row, piece, code = row[order], np.concatenate([x[1] for x in out])[order], np.concatenate([x[2] for x in out])[order]
                row, piece = self._bytes(row, piece, code)
                count = np.bincount(row, minlength=len(some))
                sizes[some] = count
                for i, part in zip(some.tolist(), np.split(piece, np.cumsum(count)[:-1]), strict=True):
                    flat[i] = part
        return sizes, np.concatenate(flat) if flat else np.zeros(0, np.int64)

    def _bytes(self, row: np.ndarray, piece: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without piece as byte pieces, or as the unknown id (neighbours as one)."""
        none = piece < 0
        if not none.any():
            return row, piece
        if not self.fallback:
            piece = np.where(none, self.unknown, piece)
            twice = np.zeros(len(piece), bool)
            twice[1:] = none[1:] & none[:-1] & (row[1:] == row[:-1])
            return row[~twice], piece[~twice]
        raw = {c: self.bytes_[np.frombuffer(chr(c).encode(), np.uint8)] for c in set(code[none].tolist())}
        parts = [raw[c] if x else np.array([p]) for p, c, x in zip(piece.tolist(), code.tolist(), none.tolist(), strict=True)]
        return np.repeat(row, [len(x) for x in parts]), np.concatenate(parts)

    def decode(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of texts, and how many each has; the dummy prefix is taken off."""
        n = self.at[ids + 1] - self.at[ids]
        edge = np.cumsum(n) - n
        flat = self.flat[np.repeat(self.at[ids] - edge, n) + np.arange(n.sum())]
        ends = np.cumsum(size)
        sums = np.concatenate(([0], np.cumsum(n)))
        out = sums[ends] - sums[ends - size]
        start = np.cumsum(out) - out
        full = np.flatnonzero(out)
        lead = full[flat[start[full]] == 0x20]
        keep = np.ones(len(flat), bool)
        keep[start[lead]] = False
        out[lead] -= 1
        return flat[keep], out


class PieceEncoder(Memo):
    """Ids of texts that start with the dummy prefix, a space; words and their ids are remembered."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def cut(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        first = np.zeros(len(buf), bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        first[1:] |= ~self.vocabulary.joined[buf[:-1].astype(np.uint16) * np.uint16(256) + buf[1:]]
        return np.flatnonzero(first)

    def encoded(self, texts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        return list(range(len(texts))), *self.vocabulary.encode([x.replace(" ", SPACE) for x in texts])


_WORKER: weakref.WeakKeyDictionary[Broadcast, PieceEncoder] = weakref.WeakKeyDictionary()  #: by their model, so that a worker lets go of them at its first task that does not use it


def _ready(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = batch.column("text").cast(pa.large_string())
    return W.buffers(pc.if_else(pc.greater(pc.fill_null(pc.binary_length(text), 0), 0), pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pc.fill_null(text, ""), pa.scalar(" ", pa.large_string())), pa.scalar("", pa.large_string())))


def _small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of few rows, of which several copies are held."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _encoded(batch: pa.RecordBatch, shared: Broadcast) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, ids and their number by row."""
    if shared not in _WORKER:
        _WORKER[shared] = PieceEncoder(shared.value)
    buf, offsets = _ready(batch)
    for i, j in W.chunks(offsets):
        yield i, j, *_WORKER[shared].ids(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of every row of docs (doc_id, text)."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            for i, j, ids, size in _encoded(batch, shared):
                offsets = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(frame: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of frame (doc_id, ids). Null ids are empty; bytes that are no UTF-8 become U+FFFD; ids that the model lacks raise."""
    shared = small_batches(frame).sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids")
            size = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
            raw, n = shared.value.decode(np.asarray(column.flatten()).astype(np.int64), size)
            data, ends = raw.tobytes(), np.cumsum(n)
            texts = [data[e - k : e].decode(errors="replace") for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return frame.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256, round_trip (the decoded text is the text) of every row."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            own, off = W.buffers(batch.column("text"))
            for i, j, ids, size in _encoded(batch, shared):
                raw, n = shared.value.decode(ids.astype(np.int64), size)
                flat, data, mine = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B"), raw.tobytes(), own[off[i] : off[j]].tobytes()
                b, d, o = np.cumsum(size).tolist(), np.cumsum(n).tolist(), (off[i : j + 1] - off[i]).tolist()
                crc = [zlib.crc32(flat[4 * (e - k) : 4 * e]) for e, k in zip(b, size.tolist(), strict=True)]
                texts = [data[e - k : e] for e, k in zip(d, n.tolist(), strict=True)]
                same = [x == mine[a:z] for x, a, z in zip(texts, o[:-1], o[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()), pa.array(same, pa.bool_())],
                    ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), model())
