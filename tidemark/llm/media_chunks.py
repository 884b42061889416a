"""Media columns (op7): payloads as content-defined chunks, stored once, read back and verified.

A document's payload is its UTF-8 text (null: empty) with zero bytes up to a
positive multiple of 64. A gear hash of the last 16 bytes cuts it into chunks
of 256 to 16384 bytes, so an edit changes the chunks around it only.

1. `index`: for each document the digest of its payload and of its chunks.
2. Chunk digests of distinct payloads meet in Spark: a digest that several
   payloads hold is shared, and the least payload owns its bytes.
3. Payloads travel once, packed and compressed, to the bucket of their digest,
   where they meet their shared digests (a join by bucket). A pack stores its
   payloads' own chunks and ordered chunk lists; shared chunks are rows of
   their own, by digest. This is the written store.
4. The store is read back. Payloads without shared chunks are rebuilt from
   their pack; for others the missing chunks are joined by digest. Each rebuilt
   payload must have the digest that it is stored under.

The stored form of one payload is its chunk list (magic, sizes, digests), which
stands in its pack as it is, and the samples of its chunks, 8 bits each; both
are read back, and no list is made anew. Documents with equal texts share one payload, so hot groups
of copies are rebuilt once. doc_id may be null or repeat; extra columns are
ignored. Digests are 128-bit blake2b.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .exchange import buckets
from .session import small_batches, stage

UNIT = 64
LEAST, MOST, BITS = 256, 16384, 11  #: bytes of a chunk at least and at most; a cut is at one position in 2**BITS
PACK = 4 << 20  #: bytes of payloads in one pack
LEVEL = 12  #: of zstd, for packs and their way to them; the next level takes over four times its CPU for 1 % less
DIGEST = 16
MAGIC = b"TMC1"  #: before each stored chunk list

_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT if text else UNIT)


def cut_points(buf: np.ndarray) -> np.ndarray:
    """Positions after which the gear hash, sum of gear[b[i - j]] << j over 16 bytes, allows a cut."""
    h = _GEAR[buf]
    for s in (1, 2, 4, 8):
        more = h.copy()
        more[s:] += h[:-s] << np.uint32(s)
        h = more
    return np.flatnonzero((h >> np.uint32(16 - BITS)) & np.uint32((1 << BITS) - 1) == 0) + 1


def chunk(data: bytes, cuts: list[int] | None = None) -> list[bytes]:
    """The chunks of one payload. cuts: allowed cuts within it, ascending."""
    if cuts is None:
        cuts = cut_points(np.frombuffer(data, np.uint8)).tolist()
    out, at, n = [], 0, len(data)
    for c in (*cuts, n):
        while c - at > MOST:
            out.append(data[at : at + MOST])
            at += MOST
        if c - at >= LEAST or c == n and c > at:
            out.append(data[at:c])
            at = c
    return out


def payloads(column: pa.Array) -> Iterator[tuple[int, bytes]]:
    """Length of the text, and payload."""
    for x in column:
        raw = x.as_buffer().to_pybytes() if x.is_valid else b""
        yield len(raw), payload(raw)


def _cut_each(datas: list[bytes]) -> Iterator[list[bytes]]:
    """Chunks of many payloads; cuts are found over several at once but hash each payload's own bytes."""
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in datas])))
    for i, j in W.chunks(offsets, 1 << 20):
        part = datas[i:j]
        lead = bytes(16)  # the hash of a payload's first bytes must not see its neighbour
        buf = np.frombuffer(lead.join([b"", *part]), np.uint8)
        cuts = cut_points(buf)
        start = offsets[i:j] - offsets[i] + 16 * np.arange(1, j - i + 1)
        lo, hi = np.searchsorted(cuts, start, "right"), np.searchsorted(cuts, start + np.diff(offsets[i : j + 1]), "left")
        for x, s, a, b in zip(part, start.tolist(), lo.tolist(), hi.tolist(), strict=True):
            yield chunk(x, (cuts[a:b] - s).tolist())


def _bucket(keys: list[bytes], n: int) -> np.ndarray:
    return (np.frombuffer(b"".join(keys), "<u8")[:: DIGEST // 8] % np.uint64(n)).astype(np.int32) if keys else np.zeros(0, np.int32)


def index(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, key (digest of the payload), chunks (array of digests)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = list(payloads(batch.column("text").cast(pa.string())))
            datas = [x for _, x in both]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for n, _ in both], pa.int64()), pa.array([digest(x) for x in datas], pa.binary()), pa.array([[digest(c) for c in x] for x in _cut_each(datas)], pa.list_(pa.binary()))],
                ["doc_id", "n_bytes", "key", "chunks"],
            )

    return docs.mapInArrow(run, "doc_id long, n_bytes long, key binary, chunks array<binary>")


_STORE = "kind int, key binary, refs binary, data binary"
_OWN, _SHARED = 0, 1


def store(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """The media store. kind 0: a pack (key: payload digests; refs: their chunk lists; data: the packs' own chunks); kind 1: a shared chunk by digest."""
    n = buckets(docs)
    refs = listed.dropDuplicates(["key"]).select("key", F.explode(F.array_distinct("chunks")).alias("digest"))
    shared = refs.groupBy("digest").agg(F.min("key").alias("owner"), F.count("*").alias("k")).where("k > 1").select("digest", "owner")
    mine = refs.join(shared, "digest").select("key", "digest", (F.col("key") == F.col("owner")).alias("own"))

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pa.array(_bucket(batch.column("key").to_pylist(), n), pa.int32())
            yield pa.RecordBatch.from_arrays([at, *batch.columns], ["bucket", *batch.schema.names])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, held, size = zstandard.ZstdCompressor(level=LEVEL), {}, 0

        def flush() -> pa.RecordBatch:
            keys = list(held)
            rows: dict[int, list[bytes]] = {}
            for k, b in zip(keys, _bucket(keys, n).tolist(), strict=True):
                rows.setdefault(b, []).append(held[k])
            sizes = [np.array([len(x) for x in v], "<i8").tobytes() for v in rows.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array(sizes, pa.binary()), pa.array([press.compress(b"".join(v)) for v in rows.values()], pa.binary())], ["bucket", "sizes", "data"])

        for batch in batches:
            for _, x in payloads(batch.column("text").cast(pa.string())):
                if (k := digest(x)) not in held:
                    held[k] = x
                    size += len(x)
                if size >= 16 * PACK:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    def build(packed: pa.Table, known: pa.Table) -> Iterator[pa.RecordBatch]:
        press, unpress = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        role: dict[bytes, dict[bytes, bool]] = {}
        for k, d, own in zip(*(known.column(c).to_pylist() for c in ("key", "digest", "own")), strict=True):
            role.setdefault(k, {})[d] = own
        done, keys, refs, data, give, size = set(), [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            rows = [(_OWN, b"".join(keys), b"".join(refs), press.compress(b"".join(data))), *((_SHARED, d, b"", press.compress(x)) for d, x in give)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], ["kind", "key", "refs", "data"])

        for sizes, blob in zip(packed.column("sizes"), packed.column("data"), strict=True):
            raw, ends = unpress.decompress(blob.as_buffer()), np.cumsum(np.frombuffer(sizes.as_buffer(), "<i8"))
            datas = [raw[a:b] for a, b in zip((0, *ends[:-1].tolist()), ends.tolist(), strict=True)]
            for x, chunks in zip(datas, _cut_each(datas), strict=True):
                if (k := digest(x)) in done:
                    continue
                done.add(k)
                mark, line, given, elsewhere = role.get(k, {}), [], set(), bytearray()
                for c in chunks:
                    d = digest(c)
                    line.append(struct.pack("<i16s", len(c), d))
                    elsewhere.append(d in mark)
                    if d in mark:
                        if mark[d] and d not in given:
                            given.add(d)
                            give.append((d, c))
                    else:
                        data.append(c)
                        size += len(c)
                keys.append(k)
                refs.append(MAGIC + struct.pack("<qi", len(x), len(line)) + b"".join(line) + elsewhere)
                if size >= PACK:
                    yield flush()
                    keys, refs, data, give, size = [], [], [], [], 0
        if keys:
            yield flush()

    packed = docs.mapInArrow(send, "bucket int, sizes binary, data binary")
    known = mine.mapInArrow(bucketed, "bucket int, key binary, digest binary, own boolean")
    return packed.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(lambda a, b: pa.Table.from_batches(build(a, b) if len(a) else (), _SCHEMA), _STORE)


_SCHEMA = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("refs", pa.binary()), ("data", pa.binary())])


def _lists(refs: bytes) -> Iterator[tuple[bytes, list[tuple[int, bytes]]]]:
    """Stored chunk lists: their bytes, and (size, digest) of each chunk; the size is negative where the chunk is a shared one."""
    at = 0
    while at < len(refs):
        if refs[at : at + 4] != MAGIC:
            raise ValueError("a stored chunk list is damaged")
        (k,) = struct.unpack_from("<i", refs, at + 12)
        end = at + 16 + 20 * k
        line = [struct.unpack_from("<i16s", refs, at + 16 + 20 * i) for i in range(k)]
        yield refs[at:end], [(-n if refs[end + i] else n, d) for i, (n, d) in enumerate(line)]
        at = end + k


def features(key: bytes, listed: bytes, data: bytes) -> tuple:
    """The columns of one rebuilt payload, which must be what was stored. listed: its stored chunk list."""
    if digest(data) != key:
        raise ValueError(f"stored media {key.hex()} came back changed")
    x = np.frombuffer(data, np.uint8).astype(np.float64) - 128
    crossings = int(np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1])))
    text = f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={crossings}"
    whole = hashlib.sha256(listed)
    whole.update(data)
    return key, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(listed) + len(data), whole.hexdigest(), text


_FEATURES = "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _rows(found: list[tuple]) -> list[pa.Array]:
    kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return [pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)]


_NAMES = [x.split()[0] for x in _FEATURES.split(", ")]


def rebuild(media: DataFrame) -> DataFrame:
    """Read the store back: one row of `features` for each payload."""
    n = buckets(media)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finished payloads, and for the others their parts: bucket, key, refs, own bytes, and the digests they lack."""
        for batch in batches:
            for keys, refs, blob in zip(*(batch.column(c).to_pylist() for c in ("key", "refs", "data")), strict=True):
                raw, at, done, part = zstandard.ZstdDecompressor().decompress(blob), 0, [], []
                for i, (listed, line) in enumerate(_lists(refs)):
                    key = keys[DIGEST * i : DIGEST * (i + 1)]
                    size = sum(k for k, _ in line if k > 0)
                    data, at = raw[at : at + size], at + size
                    if all(k > 0 for k, _ in line):
                        done.append(features(key, listed, data))
                    else:
                        part.append((key, listed, line, data))
                press = zstandard.ZstdCompressor(level=3)
                lack = [pa.array([None] * len(done), pa.int32()), pa.array([None] * len(done), pa.binary()), pa.array([None] * len(done), pa.binary()), pa.array([None] * len(done), pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays([*_rows(done), *lack], [*_NAMES, "bucket", "refs", "data", "lacks"])
                rows = _rows([(k, None, None, None, None, None, None) for k, _, _, _ in part])
                lines = [listed + bytes(k < 0 for k, _ in line) for _, listed, line, _ in part]
                more = [pa.array(_bucket([k for k, _, _, _ in part], n), pa.int32()), pa.array(lines, pa.binary()), pa.array([press.compress(d) for _, _, _, d in part], pa.binary()), pa.array([sorted({d for k, d in line if k < 0}) for _, _, line, _ in part], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays([*rows, *more], [*_NAMES, "bucket", "refs", "data", "lacks"])

    def join(table: pa.Table) -> pa.Table:
        unpress, have, found = zstandard.ZstdDecompressor(), {}, []
        for d, x in zip(table.column("digest").to_pylist(), table.column("chunk").to_pylist(), strict=True):
            if d is not None:
                have[d] = x
        for key, refs, data in zip(*(table.column(c).to_pylist() for c in ("key", "refs", "data")), strict=True):
            if refs is None:
                continue
            ((listed, line),) = _lists(refs)
            own, at, out = unpress.decompress(data), 0, []
            for k, d in line:
                if k > 0:
                    out.append(own[at : at + k])
                    at += k
                else:
                    out.append(unpress.decompress(have[d]))
            found.append(features(key, listed, b"".join(out)))
        return pa.Table.from_arrays(_rows(found), _NAMES)

    read = stage(media.where(F.col("kind") == _OWN).mapInArrow(whole, f"{_FEATURES}, bucket int, refs binary, data binary, lacks array<binary>"), "features")
    part = read.where("refs IS NOT NULL")
    chunks = media.where(F.col("kind") == _SHARED).select(F.col("key").alias("digest"), F.col("data").alias("chunk"))
    want = part.select("bucket", F.explode("lacks").alias("digest")).distinct().join(chunks, "digest")  # once for each bucket that lacks it
    none = F.lit(None).cast("binary")
    both = part.select("bucket", "key", "refs", "data", none.alias("digest"), none.alias("chunk")).unionByName(want.select("bucket", none.alias("key"), none.alias("refs"), none.alias("data"), "digest", "chunk"))
    return read.where("refs IS NULL").select(*_NAMES).unionByName(both.groupBy("bucket").applyInArrow(join, _FEATURES))


def columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every row, from the store as read back."""
    docs = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    listed = stage(index(docs), "index")
    media = stage(store(docs, listed), "media", compression="none")
    return listed.select("doc_id", "n_bytes", "key").join(rebuild(media), "key").select("doc_id", "n_bytes", *_NAMES[1:])


def op7_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
