import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import substring_dedup, suffix_dedup

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.StringType())])


def brute(rows, k):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in docs:
        for j in range(len(w) - k + 1) if i is not None else ():
            key = tuple(w[j : j + k])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1) if i is not None else ():
            if least[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def texts(seed):
    r = random.Random(seed)
    vocab = [f"w{i}é" for i in range(400)] + ["the", "of", "a"] * 60
    base = [[r.choice(vocab) for _ in range(r.choice([0, 1, 5, 12, 13, 14, 40, 90, 300]))] for _ in range(60)]
    for _ in range(60):  # near copies, shared passages, loops
        a, b = list(r.choice(base)), r.choice(base)
        kind = r.randrange(4)
        if kind == 0:
            for _ in range(r.randrange(4)):
                if a:
                    a[r.randrange(len(a))] = r.choice(vocab)
        elif kind == 1:
            at, n = r.randrange(len(b) + 1), r.randrange(10, 60)
            a[len(a) // 2 : len(a) // 2] = b[at : at + n]
        elif kind == 2:
            a = (a[: r.randrange(1, 20)] or ["x"]) * r.randrange(1, 12)
        base.append(a)
    sep = [" ", "\n", "\t ", "  ", "\x0b"]
    return [(i // 2 if i % 17 == 0 else i, "".join(w + r.choice(sep) for w in x)) for i, x in enumerate(base)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("run", "k"), [(substring_dedup.digest, 13), (suffix_dedup.digest, 32)])
def test_equals_brute_force(spark, seed, run, k):
    rows = texts(seed) + [(None, texts(seed)[5][1]), (None, None), (990, None), (991, ""), (992, " \n"), (993, "a " * 5000), (994, "b " + "a " * 3000)]
    got = run(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows, k)


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup])
def test_empty_table(spark, op):
    assert op.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert op.clean(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup])
def test_clean_keeps_columns_of_any_name(spark, op):
    a = " ".join(f"a{i}" for i in range(50))
    rows = [(1, f"{a} one"), (2, f"{a} two"), (3, a), (None, a), (4, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.lit(7).alias("my col"), F.struct(F.lit("x").alias("odd name")).alias("a.b"), "text", F.lit(True).alias("__"), F.lit(1).alias("spans"), F.lit(2).alias("rest"))
    out = op.clean(frame)
    assert out.columns == frame.columns and [f.dataType for f in out.schema] == [f.dataType for f in frame.schema]
    got = sorted(((x["doc_id"], x["text"], x["my col"], x["a.b"][0], x["rest"]) for x in out.collect()), key=str)
    assert got == sorted([(1, f"{a} one", 7, "x", 2), (2, "two", 7, "x", 2), (None, a, 7, "x", 2), (4, None, 7, "x", 2)], key=str)


def twins(n=1024):
    """Two texts of n letters that polynomial hashes modulo 2**64 cannot tell apart."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize(("run", "k"), [(substring_dedup.digest, 13), (suffix_dedup.digest, 32)])
def test_texts_that_weak_hashes_confuse(spark, run, k):
    s, t = twins()
    tail = " ".join(f"c{i}" for i in range(40))
    rows = [(1, f"{s} {tail}"), (2, f"{t} {tail}"), (3, " ".join(s)), (4, " ".join(t)), (5, " ".join(twins(2048)[0])), (6, " ".join(twins(2048)[1]))]
    got = run(spark.createDataFrame([(*r, "") for r in rows], SCHEMA))
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows, k)


def test_sparse_suffixes_are_ordered_and_extended():
    r = np.random.default_rng(3)
    words = r.integers(1, 4, 400).astype(np.uint64)
    words[200:300] = words[20:120]  # a passage that stands twice
    first = np.array([0, 200, 400])
    p, row, h = suffix_dedup.sampled(words, first, 32, 12)
    assert all(np.any((p >= a) & (p <= a + 20)) for a in range(168))  # each passage of 32 words holds a retained suffix
    a, b, right, left = suffix_dedup.contexts(words, first, p, row, 32, 12)
    order, common = suffix_dedup.ordered(a)
    rows = [tuple(x) for x in a[order].tolist()]
    assert rows == sorted(rows)  # the order of the suffixes
    for x, y, n in zip(rows, rows[1:], common[1:].tolist()):  # common prefixes of neighbours
        assert x[:n] == y[:n] and (n == 32 or x[n] != y[n])
    hit = suffix_dedup.judged(a, b, right, left, row.astype(np.int64), 32, 12)
    gone = np.zeros(400, bool)
    for i, lo, hi in zip(*suffix_dedup._merged(hit, 32)):
        gone[p[i] + lo : p[i] + hi] = True
    assert not gone[:200].any() and gone[200:300].all()


def test_paths_compact_across_nonbranching_nodes(spark):
    # documents 2 and 3 have the blocks 10 > 11 > 12; 3 goes on to 13, and 4 enters 12 from 14
    rows = [(2, 0, 14, 10), (2, 2, 14, 11), (2, 4, 14, 12), (3, 5, 14, 10), (3, 7, 14, 11), (3, 9, 14, 12), (3, 11, 14, 13), (4, 0, 14, 14), (4, 2, 14, 12), (9, 0, 14, 10), (9, 2, 14, 11)]
    marks = spark.createDataFrame(rows, "doc_id long, start int, n int, key long")
    got = sorted(tuple(x) for x in substring_dedup.compacted(marks, spark.createDataFrame([(9,)], "doc_id long"), 13).collect())
    assert got == [(2, 0, 16, 10 ^ 11), (2, 4, 18, 12), (3, 5, 21, 10 ^ 11), (3, 9, 25, 12 ^ 13), (4, 0, 14, 14), (4, 2, 16, 12), (9, 0, 14, 10), (9, 2, 16, 11)]


def test_long_word_and_text(spark):
    long = "x" * 3_000_000
    rows = [(1, long + " " + " ".join(map(str, range(200_000)))), (2, "y " + " ".join(map(str, range(50, 100))) + " " + long)]
    got = substring_dedup.digest(spark.createDataFrame([(*r, "") for r in rows], SCHEMA))
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows, 13)
