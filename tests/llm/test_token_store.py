import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm import token_store as S
from tidemark.llm import words as W

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())])
PATH = S.vocabulary()
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True


def brute(rows):
    out, at = [], 0
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = np.array([*PLAIN.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    r = random.Random(2)
    words = ["the", "naïve", "it's", "I'll", "12", "3.5", "...", "x" * 50, "日本", " ", "é", "\n", "  ", " ", "<|endoftext|>"]
    rows = [(i * 3 % 101, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 9, 200])))) for i in range(101)]
    rows += [(None, "null id"), (None, None), (5, "again"), (500, None), (501, ""), (502, "long " * 100_000), (-3, "before")]
    got = S.read(S.write(spark.createDataFrame([(*x, "") for x in rows], SCHEMA).repartition(5), PATH))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows)


def test_many_segments(spark, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 50)
    rows = [(i, "a few words here " * (i % 7)) for i in range(60)]
    store = S.write(spark.createDataFrame([(*x, "") for x in rows], SCHEMA), PATH)
    assert sorted((tuple(x) for x in S.read(store).collect()), key=str) == brute(rows)


def test_documents_by_select(spark, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 40)
    rows = [(i * 7 - 30, f"some words of {i} " * (i % 5)) for i in range(40)] + [(5, "twice"), (5, "again"), (None, "no id"), (2**62, "far"), (-(2**62), "before")]
    store = S.write(spark.createDataFrame([(*x, "") for x in rows], SCHEMA), PATH)
    got = sorted((x["doc_id"], x["ids"]) for x in S.ids_of(store, spark.createDataFrame([(5,), (-30,), (2**62,), (999,), (None,), (5,)], "doc_id long")).collect())
    want = sorted((i, [*PLAIN.encode(t, add_special_tokens=False).ids, 0]) for i, t in rows if i in (5, -30, 2**62))
    assert got == want and len(got) == 5
    assert sorted((tuple(x) for x in S.read(store).collect()), key=str) == brute(rows)


def test_rows_without_doc_id_are_dealt_to_several_shards(spark):
    rows = [(None, f"{i} a text without a number") for i in range(400)]
    store = S.write(spark.createDataFrame([(*x, "") for x in rows], SCHEMA).repartition(4), PATH)
    assert store.select("shard").distinct().count() > 1
    assert sorted((tuple(x) for x in S.read(store).collect()), key=str) == brute(rows)


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(S.Encoder, "hashed", lambda self, *spans: (np.full(len(spans[1]), 7, np.uint64), *W.hashes_and_ends(*spans)[1:]))
    e = S.Encoder(PATH)
    texts = ["the first text", "another, longer pieceofatextwithoutblanks " * 3, "the", "", "pieceofatextwithoutblanks"]
    flat, size = e.ids(*W.buffers(pa.array(texts, pa.string())))
    assert flat.tolist() == [i for t in texts for i in [*PLAIN.encode(t, add_special_tokens=False).ids, 0]] and size.sum() == len(flat)


def test_texts_that_weak_hashes_confuse():
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    texts = ["".join("ab"[b] for b in bits[:n]) for n in (1024, 2048)] + ["".join("ba"[b] for b in bits[:n]) for n in (1024, 2048)]
    flat, _ = S.Encoder(PATH).ids(*W.buffers(pa.array(texts, pa.string())))
    assert flat.tolist() == [i for t in texts for i in [*PLAIN.encode(t, add_special_tokens=False).ids, 0]]


def test_empty_table(spark):
    assert S.read(S.write(spark.createDataFrame([], SCHEMA), PATH)).count() == 0


letters = st.text(st.sampled_from("ab'sSé1٣²  \n\t\r\x0b\x0c\x1c\x1f\x7f\x85\xa0     　à日.,-_<|>Ώ\U0001f600"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(letters, st.text(max_size=20)), min_size=1, max_size=6))
def test_pieces_are_exact(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    flat, size = S.encoder(PATH).ids(*W.buffers(pa.array(texts, pa.string())))
    want = [[*PLAIN.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert flat.tolist() == [i for x in want for i in x] and size.tolist() == [len(x) for x in want]


def test_small_memory_gives_the_same():
    texts = pa.array([f"w{i} v{i % 7} é" for i in range(300)])
    whole = S.Encoder(PATH).ids(*W.buffers(texts))
    for n in (3, 100, 450):
        small = S.Encoder(PATH)
        small.remember = n
        for _ in range(2):
            got = small.ids(*W.buffers(texts))
            assert all((a == b).all() for a, b in zip(whole, got, strict=True))


@given(st.lists(st.integers(0, 5000), max_size=300))
def test_elias_fano(steps):
    values = np.cumsum(np.array(steps, np.int64)) if steps else np.zeros(0, np.int64)
    ef = S.EliasFano.of(values)
    assert ef.all().tolist() == values.tolist() == [ef[i] for i in range(len(values))]
    with pytest.raises(IndexError):
        ef[len(values)]
    if len(values) > 50:
        assert len(ef.low) + len(ef.high) + len(ef.samples) < 8 * len(values)
