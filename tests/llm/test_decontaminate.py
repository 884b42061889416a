import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import decontaminate as D

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("items", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.StringType())])


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items):
    windows = {}
    for k, t in items:
        w = words(t)
        for j in range(max(1, len(w) - 12) if w and k is not None else 0):
            windows.setdefault(tuple(w[j : j + 13]), set()).add(str(k))
    out = []
    for i, t in docs:
        w, found = words(t), set()
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (x := tuple(w[j : j + n])) in windows:
                    hit[j : j + n] = [True] * n
                    found |= windows[x]
        k = sum(hit)
        out.append((i, len(w), k, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), k > 0 and 20 * k >= len(w)))
    return sorted(out, key=str)


def tables(seed, shortest):
    r = random.Random(seed)
    vocab = [f"W{i}ü" for i in range(50)] + ["The", "of", "a"] * 15
    item = lambda n: "; ".join(r.choice(vocab) for _ in range(n))
    items = [(i, item(r.choice([shortest, 5, 12, 13, 14, 30, 45]))) for i in range(30)]
    items += [(3, items[4][1] + " tail"), (40, items[5][1]), (41, None), (42, "--"), (None, item(20))]
    docs = []
    for i in range(80):
        t = " ".join(r.choice(vocab) for _ in range(r.choice([0, 3, 40, 200])))
        for _ in range(r.randrange(3)):
            w = words(r.choice(items)[1])
            a = r.randrange(len(w) + 1)
            part = " ".join(w[a : a + r.randrange(5, 40)]).upper().replace("Ü", "ü")
            t = part + "," + t if r.random() < 0.5 else t + "\n" + part
        docs.append((i // 2 if i % 9 == 0 else i, t))
    return [*docs, (None, docs[3][1]), (500, None), (501, ""), (502, " .\x7f ")], items


@pytest.mark.parametrize(("seed", "shortest", "shard"), [(1, 1, 10**6), (2, 2, 10**6), (3, 13, 150), (4, 1, 40)])
def test_equals_brute_force(spark, seed, shortest, shard):
    docs, items = tables(seed, shortest)
    d = spark.createDataFrame([(*x, "") for x in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(*x, "") for x in items], ITEMS)
    got = sorted((tuple(x) for x in D.digest(d, b, shard_words=shard).collect()), key=str)
    assert got == brute(docs, items)
    spans = {(x["doc_id"], x["all_words"], x["hit_words"]) for x in D.spans(d.withColumn("a b.c", F.struct(F.lit(1).alias("odd name"))), b, shard_words=shard).collect()}
    assert spans == {(x[0], x[1], x[2]) for x in got}


def test_clean_drops_contaminated_and_cuts_spans(spark):
    item = " ".join(f"q{i}" for i in range(20))
    long = " ".join(f"x{i}" for i in range(600))
    rows = [(1, "é " + item), (2, f"  {long}. {item}, end"), (3, f"{long}  kept!"), (4, None)]
    d = spark.createDataFrame([(*x, "e") for x in rows], DOCS)
    out = {x["doc_id"]: x for x in D.clean(d, spark.createDataFrame([(1, item, "")], ITEMS)).collect()}
    assert set(out) == {2, 3, 4}
    assert out[2]["text"] == f"  {long}. , end" and out[3]["text"] == rows[2][1] and out[4]["text"] is None
    assert out[2]["items"] == "e"


def test_clean_in_several_passes_is_the_same(spark):
    docs, items = tables(6, 5)
    d = spark.createDataFrame([(*x, "") for x in docs], DOCS)
    b = spark.createDataFrame([(*x, "") for x in items], ITEMS)
    one, many = (sorted((tuple(x) for x in D.clean(d, b, shard_words=n).collect()), key=str) for n in (10**6, 30))
    assert one == many and len(one) < len(docs)


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert D.digest(d, b).count() == 0
    one = D.digest(spark.createDataFrame([(1, "a b", "")], DOCS), b).collect()
    assert [tuple(x)[:4] for x in one] == [(1, 2, 0, 0)]
