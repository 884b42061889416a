import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import language_id as L
from tidemark.llm import toxicity as X

SF = "/root/testdata/sf0.01"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("score", T.StringType())])
EN, DE = "the cat sat on that mat with the other cats and then they slept", "der hund und die katze schlafen nicht immer unter dem großen baum"


def sample():
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de", "") for i in range(40)]
    return [*rows, (100, None, "en", ""), (101, "", "de", ""), (102, "12 !? 7", "de", ""), (103, EN + " the" * 40_000, None, ""), (None, DE, "de", ""), (104, EN + ". " + DE, None, ""), (104, EN, "en", ""), (105, "ж", "en", "")]


def test_language_cases(spark):
    got = {}
    for x in L.predict(spark.createDataFrame(sample(), DOCS)).collect():
        got.setdefault(x["doc_id"], []).append(x)
        if x["doc_id"] is not None:
            assert x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2)
        assert 0 <= x["score"] <= 1 and not math.isnan(x["score"])
    assert all(got[i][0]["lang_pred"] == ("en" if i % 2 else "de") for i in range(40))
    assert [got[i][0]["lang_pred"] for i in (100, 101, 102, 103)] == ["und", "und", "und", "en"]
    assert got[None][0]["lang_pred"] == "de" and got[105][0]["lang_pred"] != "und" and len(got[104]) == 2


def test_language_mixture_shares(spark):
    docs = spark.createDataFrame([(1, " ".join([EN] * 3 + [DE] * 3), None, ""), (2, EN, None, ""), (3, None, None, "")], DOCS)
    model = L.fit(spark.createDataFrame(sample(), DOCS))
    got = {x["doc_id"]: x["langs"] for x in L.mixtures(docs, model).collect()}
    assert {x["lang"] for x in got[1]} == {"en", "de"} and abs(got[1][0]["share"] - 0.5) < 0.1
    assert [x["lang"] for x in got[2]] == ["en"] and got[3] == []


def test_em_equals_plain_loops():
    r = np.random.default_rng(1)
    m = L.Model(["a", "b", "c"], r.random((3, L.GRAMS)) * 100)
    c = r.integers(0, 3, (2, L.GRAMS))
    share, fit = m._em(c, np.full((2, 3), 1 / 3), 5)
    for row in range(2):
        s = [1 / 3] * 3
        for _ in range(5):
            new = [0.0] * 3
            for g in np.flatnonzero(c[row]):
                total = sum(s[k] * m.p[k, g] for k in range(3))
                for k in range(3):
                    new[k] += c[row, g] * s[k] * m.p[k, g] / total
            s = [x / c[row].sum() for x in new]
        assert np.allclose(share[row], s)
        assert math.isclose(fit[row], sum(c[row, g] * math.log(sum(s[k] * m.p[k, g] for k in range(3))) for g in np.flatnonzero(c[row])), rel_tol=1e-9)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = L.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    n, good = out.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 100 and good / n > 0.97


@pytest.mark.parametrize("run", [lambda s: L.predict(s.createDataFrame([], DOCS)), lambda s: X.predict(s.createDataFrame([], DOCS), s.createDataFrame([], LABELS))])
def test_empty_tables(spark, run):
    assert run(spark).count() == 0


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, EN, None, "")], DOCS)
    assert [tuple(x)[2:] for x in L.predict(docs).collect()] == [("und", 0.0)]
    assert [tuple(x)[2:] for x in X.predict(docs, spark.createDataFrame([(2, None, "")], LABELS)).collect()] == [(0.0, 0)]


def test_toxic_sentences_are_found(spark):
    r = np.random.default_rng(3)
    vocab = [f"w{i}x" for i in range(200)]
    line = lambda: " ".join(r.choice(vocab, 8))
    rows, labels = [], []
    for i in range(400):
        parts = [line() for _ in range(r.integers(1, 6))]
        if i % 4 == 0:
            parts[r.integers(len(parts))] += " Vileword"
        rows.append((i, ". ".join(parts), None, ""))
        labels.append((i, int(i % 4 == 0), ""))
    rows += [(900, None, None, ""), (901, "", None, ""), (902, "?!", None, ""), (None, "vileword", None, ""), (903, (line() + ". ") * 5000, None, ""), (904, "VILEWORD " + line(), None, "")]
    labels += [(0, 0, ""), (5000, 1, ""), (1, None, ""), (None, 1, "")]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    got = {x["doc_id"]: x for x in X.predict(docs, marks).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["predicted"] == (i % 4 == 0) for i in range(400))
    assert [got[i]["predicted"] for i in (900, 901, 902, None, 904)] == [0, 0, 0, 1, 1]
    assert got[901]["score"] == 0 and got[0]["held_out"] == (zlib.crc32(b"0") % 5 == 0)
    where = X.sentences(docs.where("doc_id < 400"), X.fit(docs, marks)).collect()
    assert {x["doc_id"] for x in where} == set(range(0, 400, 4)) and all("Vileword" in x["text"] for x in where)


def test_noisy_or_equals_plain_loops(spark):
    m = X.Model(np.random.default_rng(2).normal(0, 1, 1 << X.BITS), -1.0)
    import pyarrow as pa

    texts = pa.array(["a b. c! d e f", None, "", "g\nh"])
    want = np.zeros(4)
    for at, h, head, row, _ in X.instances(texts):
        for d in range(4):
            p = [1 / (1 + math.exp(-(sum(float(m.weight[f]) for w in h[a:b] for f in w) - 1))) for a, b, o in zip(head, np.append(head[1:], len(h)), row) if o + at == d]
            want[d] = 1 - math.prod(1 - x for x in p)
    assert np.allclose(m.scores(texts), want)


def test_few_labels_are_learned_from(spark):
    r = random.Random(12)
    vocab = [f"word{i}" for i in range(300)]
    line = lambda: " ".join(r.choice(vocab) for _ in range(12))
    rows = [(i, f"{line()}. {line()}{' vile' if i % 2 else ''} {line()}.") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in X.score(docs, X.fit(docs, labels)).collect()}
    assert sum(got[i]["predicted"] == i % 2 for i, _ in rows) >= 28
    bounded = X.fit(docs, labels, train_bytes=1000)  # a few whole texts of each class
    assert bounded.weight.shape == (1 << X.BITS,)


def test_extra_columns_of_the_same_names(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", 0.5, "x", 3), (2, "der hund und die katze", "de", 0.1, "y", 4)], "doc_id long, text string, lang string, score double, `a.b c` string, lang_pred int")
    out = L.annotate(docs, L.fit(docs))
    assert out.columns == ["doc_id", "text", "lang", "a.b c", "lang_pred", "score"]
    assert {x["doc_id"]: (x["lang_pred"], x["a.b c"]) for x in out.collect()} == {1: ("en", "x"), 2: ("de", "y")}


def test_language_set_equals_plain_loops():
    r = np.random.default_rng(4)
    m = L.Model(["a", "b", "c"], r.integers(0, 40, (3, L.GRAMS)) ** 2)
    c = np.zeros((6, L.GRAMS), np.int64)
    for i in range(6):
        for k in ([0], [1], [0, 1], [2], [0, 2], [0, 1, 2])[i]:
            c[i] += r.multinomial(60, m.p[k])

    def em(row, share, steps):
        for _ in range(steps):
            q = share @ m.p + 1e-300
            share = np.array([share[k] * (row * m.p[k] / q).sum() for k in range(3)]) / max(row.sum(), 1)
        return share, (row * np.log(share @ m.p + 1e-300)).sum()

    for row, got in zip(c, m.shares(c)):
        share, fit = em(row, np.full(3, 1 / 3), L.STEPS)
        while (share > 0).sum() > 1:
            less = share.copy()
            less[np.where(share > 0, share, 2).argmin()] = 0
            less, new = em(row, less / less.sum(), 6)
            if (fit - new) / 3 >= L.PENALTY * np.log(max(row.sum(), 2)) / 2:
                break
            share, fit = less, new
        assert np.allclose(got, share, atol=1e-9)
