import random
import re

import pytest
from pyspark.sql import types as T

from tidemark.llm import jaccard_join as J
from tidemark.llm.components import components

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("v", T.StringType())])


def shingles(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute(rows):
    s = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if rows[i][0] is not None and rows[j][0] is not None and both and 100 * both >= 85 * len(s[i] | s[j]):
                a, b = root(i), root(j)
                up[a] = b
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(x), least.get(root(i)) if d is not None else None) for i, ((d, _), x) in enumerate(zip(rows, s))), key=str)


def tables(seed):
    r = random.Random(seed)
    vocab = [f"W{i}ü" for i in range(600)] + ["The", "of", "a"] * 30
    out = []
    for n in [1, 2, 3, 4, 5, 30, 60, 99, 110, 117, 130, 200, 400] * 2:
        base = [r.choice(vocab) for _ in range(n)]
        chain = list(base)
        for _ in range(r.randrange(1, 9)):  # a chain of edits: its ends need not link
            out.append(" ".join(chain))
            for _ in range(max(1, n // 60)):
                chain[r.randrange(n)] = r.choice(vocab)
        out += [" ".join(base), "\n".join(x.lower() for x in base)]
        common = ["boiler"] + [f"plate{i}" for i in range(50)]
        out.append(" ".join(common + base[: n // 4]))
    return [(i // 2 if i % 23 == 0 else i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = [*tables(seed), (None, tables(seed)[3][1]), (None, None), (900, None), (901, ""), (902, " \n"), (903, "x " * 3000), (904, "x " * 3001)]
    got = J.near(spark.createDataFrame([(*x, "") for x in rows], SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows)


def test_texts_that_weak_hashes_confuse(spark):
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    s, t = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    rows = [(1, s), (2, t), (3, " ".join(s)), (4, " ".join(t)), (5, f"{s} a b c d"), (6, f"{t} a b c d")]
    got = J.near(spark.createDataFrame([(*x, "") for x in rows], SCHEMA))
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows)


def test_equal_prefixes_and_sizes_are_one_group(spark):
    sets = spark.createDataFrame([(1, 9, [5, 6], 70, 1, 2.0, [0] * 16), (2, 9, [5, 6], 70, 1, 3.0, [7] * 16), (3, 9, [5, 7], 71, 2, 2.0, [0] * 16)], "v long, n long, prefix array<long>, g long, t long, q double, o array<long>")
    heads, members = J.groups(sets)
    assert sorted((x["g"], x["v"], x["prefix"], x["radius"]) for x in heads.collect()) == [(1, 2, [5, 6], 48), (3, 3, [5, 7], 0)]
    assert sorted((x["g"], x["v"]) for x in members.collect()) == [(1, 1), (1, 2), (3, 3)]


def test_one_long_list_that_does_not_link(spark):
    r = random.Random(4)
    common = [f"c{i}" for i in range(14)]
    rows = [(i, " ".join(common + [f"w{r.randrange(40)}" for _ in range(6)])) for i in range(700)]
    rows += [(800 + i, " ".join(common + ["same"] * 6)) for i in range(300)]
    got = J.near(spark.createDataFrame([(*x, "") for x in rows], SCHEMA).repartition(3))
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert J.near(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 7), (7, 5), (9, 9)], "a long, b long")
    got = {x["v"]: x["c"] for x in components(links).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {5: 5, 7: 5}
