import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import types as T

import corpus_pipeline as P
from tests.llm.test_decontaminate import words as item_words
from tidemark.llm import language_id, sentence_pieces

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("component_id", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def rows():
    r = random.Random(8)
    en = ["the", "with", "that", "from", "which"] * 3 + [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}ing" for i in range(300)]
    de = ["und", "der", "nicht", "über", "auch"] * 3 + [f"wört{chr(97 + i % 26)}{chr(97 + i // 26)}ung" for i in range(300)]
    text = lambda v, n: " ".join(r.choice(v) for _ in range(n))
    items = [(i, text(en, n)) for i, n in enumerate([13, 20, 40, 6])]
    passage = text(en, 60)
    out = [(i, text(de if i % 2 else en, r.choice([3, 20, 120])), "de" if i % 2 else "en", f"s{i % 3}") for i in range(60)]
    out += [(100 + i, out[2 * i][1] + (" extra" if i % 2 else ""), "en", "copy") for i in range(10)]
    out += [(200 + i, f"{text(en, 40)}\n {passage} {text(en, 30)}", "en", "p") for i in range(6)] + [(250, passage, "en", "p")]
    out += [(300, items[1][1], "en", "b"), (301, f"{text(en, 900)}. {items[2][1]}! {text(en, 5)}", "en", "b"), (302, items[3][1], "en", "b")]
    out += [(400, None, "en", None), (401, "", None, "x"), (402, "12 34", "en", "x"), (403, text(en, 20), None, None), (3, out[3][1], "de", "s0")]
    return [(*x, len(x[1]) if x[1] is not None else None, "clash") for x in out], items


def windows(words, n):
    return [tuple(words[j : j + n]) for j in range(len(words) - n + 1)]


def brute(docs, items, languages):
    docs = [d for d in docs if languages[d[0], d[1]] != "und"]
    stay, kept = near_brute([(d[0], d[1]) for d in docs]), []
    for d in sorted(docs, key=str):
        if (d[0], d[1]) in stay:
            stay.remove((d[0], d[1]))
            kept.append(d)
    docs = kept
    least, out = {}, []
    for d in sorted(docs, key=lambda d: d[0]):
        for w in windows(d[1].split(), 13):
            least.setdefault(w, d[0])
    for d in docs:
        w = d[1].split()
        gone = [False] * len(w)
        for j, x in enumerate(windows(w, 13)):
            if least[x] < d[0]:
                gone[j : j + 13] = [True] * 13
        if any(gone):
            d = (d[0], " ".join(x for x, g in zip(w, gone) if not g), *d[2:])
        if d[1]:
            out.append(d)
    known = {}
    for _, t in items:
        w = item_words(t)
        for x in windows(w, min(13, len(w))):
            known[x] = True
    docs, out = out, []
    for d in docs:
        import re

        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", d[1])]
        w = [d[1][a:b].lower() for a, b in spans]
        hit = [False] * len(w)
        for n in {len(x) for x in known}:
            for j, x in enumerate(windows(w, n)):
                if x in known:
                    hit[j : j + n] = [True] * n
        if sum(hit) and 20 * sum(hit) >= len(w):
            continue
        text, at, j = "", 0, 0
        while j < len(w):
            if hit[j]:
                k = j
                while k < len(w) and hit[k]:
                    k += 1
                text, at, j = text + d[1][at : spans[j][0]], spans[k - 1][1], k
            else:
                j += 1
        out.append((d[0], text + d[1][at:]))
    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model())
    done = []
    for i, t in out:
        ids = library.encode(t)
        done.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(t.encode()).hexdigest(), True))
    return sorted(done)


@pytest.fixture
def tables(spark, tmp_path):
    docs, items = rows()
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, items, str(tmp_path)


def test_run_equals_brute_force(spark, tables):
    docs, items, path = tables
    frame = spark.read.parquet(f"{path}/documents.parquet")
    learned = language_id.fit(language_id.held_out(frame).where("NOT held_out"))
    languages = {(x["doc_id"], x["text"]): x["lang_pred"] for x in language_id.annotate(frame.select("doc_id", "text"), learned).collect()}
    assert {languages[400, None], languages[401, ""], languages[402, "12 34"]} == {"und"}
    got = sorted(tuple(x) for x in P.run(spark, path).collect())
    assert got == brute(docs, items, languages)
    ids = {x[0] for x in got}
    assert 300 not in ids and 302 not in ids and 301 in ids and 250 not in ids and 100 not in ids and 403 in ids


def test_stages_keep_the_columns(spark, tables):
    _, _, path = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert 4 <= len(P.STAGES) <= 5
    for _, step in P.STAGES[:-1]:
        out = step(spark, docs, path)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in DOCS.fields[:5]]


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def near_brute(rows):
    """Rows (doc_id, text) that stay: of each component of links by 5-word Jaccard of 0.8 or more, the least (doc_id, text); rows without doc_id or words all stay."""
    sets = []
    for d, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w and d is not None else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for i, (d, t) in enumerate(rows):
        if sets[i]:
            least[group[i]] = min(least.get(group[i], (d, t)), (d, t))
    return sorted([*least.values(), *(x for i, x in enumerate(rows) if not sets[i])], key=str)


def stays(spark, rows):
    docs = spark.createDataFrame([(d, t, "en", "s", 0, "") for d, t in rows], DOCS)
    return sorted(((x["doc_id"], x["text"]) for x in P.near_duplicates(spark, docs, "").collect()), key=str)


def test_near_duplicates_link_from_five_words_and_four_fifths(spark):
    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**9)}"
    rows = []
    for k, changed in enumerate([0, 5, 12, 17, 18, 25, 40]):
        base = [word() for _ in range(200)]
        other = base[:90] + [word() for _ in range(changed)] + base[90 + changed :]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(other))]
    got = stays(spark, rows)
    assert got == near_brute(rows)
    ids = {d for d, _ in got}
    assert 31 not in ids and 41 in ids  # 175/217 = 0.806 is a copy, 174/218 = 0.798 is not


def test_rows_that_share_a_doc_id_go_only_for_their_own_group(spark):
    r = random.Random(6)
    a, b, c, d, e = (" ".join(f"w{r.randrange(10**9)}" for _ in range(60)) for _ in range(5))
    rows = [(1, a), (5, f"{a} more"), (5, b), (7, c), (7, d), (8, e), (8, f"{e} more"), (8, d), (9, None), (9, " "), (None, a), (None, a)]
    got = stays(spark, rows)
    assert got == near_brute(rows)
    assert (5, b) in got and (5, f"{a} more") not in got and (7, c) in got and (7, d) in got and (8, d) not in got
