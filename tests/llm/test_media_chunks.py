import hashlib
import random
import zlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import media_chunks as M
from tidemark.llm.session import stage

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType())])


def brute(rows):
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + b"\0" * ((-len(raw)) % 64)
        p = p or b"\0" * 64
        out.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    return sorted(out, key=str)


def rows():
    r = random.Random(4)
    line = lambda n: "".join(r.choice("abcdé \n") for _ in range(n))
    passage = line(6000)
    out = [(i, line(r.choice([0, 1, 63, 64, 65, 500, 5000]))) for i in range(40)]
    out += [(100 + i, line(900) + passage + line(300)) for i in range(10)]
    out += [(200 + i, out[45][1]) for i in range(30)] + [(1, out[3][1]), (None, "x"), (None, None), (300, None), (301, ""), (302, passage * 60), (303, "\0"), (304, "")]
    return out


def test_equals_brute_force_and_stores_chunks_once(spark):
    docs = spark.createDataFrame([(*x, "") for x in rows()], SCHEMA).repartition(5)
    got = M.columns(docs)
    assert got.columns == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    back = got.collect()
    assert sorted((tuple(x)[:5] for x in back), key=str) == brute(rows())
    same = {}
    for x in back:
        assert same.setdefault(x["payload_sha256"], tuple(x)[5:]) == tuple(x)[5:]
    listed = M.index(docs)
    digests = {d for x in listed.collect() for d in x["chunks"]}
    media = stage(M.store(docs, listed), "media").collect()
    own = [d for x in media if x["kind"] == 0 for _, line in M._lists(bytes(x["refs"])) for d in {d for k, d in line if k > 0}]
    shared = [bytes(x["key"]) for x in media if x["kind"] == 1]
    assert len(own) == len(set(own)) and len(shared) == len(set(shared)) > 0 and not set(own) & set(shared)
    assert set(own) | set(shared) == {bytes(d) for d in digests}
    lists = {hashlib.sha256(stored).hexdigest(): stored for x in media if x["kind"] == 0 for stored, _ in M._lists(bytes(x["refs"]))}
    assert sum(map(len, lists)) and {x["media_bytes"] - x["payload_bytes"] for x in back} <= set(map(len, lists.values()))  # the stored list and the samples


def test_chunks_are_content_defined():
    r = random.Random(1)
    a = bytes(r.randrange(97, 123) for _ in range(60_000))
    x, y = M.chunk(a), M.chunk(b"some lead" + a)
    assert b"".join(x) == a and all(len(c) <= M.MOST for c in x) and all(len(c) >= M.LEAST for c in x[:-1])
    assert len(set(x) - set(y)) <= 2
    assert list(M._cut_each([a, a[:70], b"", a[5:]])) == [x, M.chunk(a[:70]), [], M.chunk(a[5:])]


def test_gear_hash_equals_a_loop():
    data = bytes(range(200)) * 3
    want = [i + 1 for i in range(len(data)) if (sum(int(M._GEAR[data[i - j]]) << j for j in range(min(16, i + 1))) % 2**32 >> (16 - M.BITS)) & (2**M.BITS - 1) == 0]
    import numpy as np

    assert M.cut_points(np.frombuffer(data, np.uint8)).tolist() == want


def test_empty_table(spark):
    assert M.columns(spark.createDataFrame([], SCHEMA)).count() == 0


def test_changed_bytes_are_noticed(spark):
    import pytest

    with pytest.raises(ValueError, match="changed"):
        M.features(M.digest(b"a" * 64), [(64, b"x" * 16)], b"b" * 64)
    assert F is not None


def test_packing_stays_cheap():
    import time

    import pyarrow.parquet as pq
    import zstandard

    pack = "".join(x for x in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").to_pylist() if x).encode()[: M.PACK]

    def cpu(level):
        press, began = zstandard.ZstdCompressor(level=level), time.thread_time()
        press.compress(pack)
        return time.thread_time() - began

    assert min(cpu(M.LEVEL) for _ in range(3)) < 5 * min(cpu(9) for _ in range(3))
