import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tidemark.llm import sentence_pieces as S
from tidemark.llm import words as W

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())])
PATH = S.model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
VOCABULARY = S.Vocabulary(PATH)


def ids_of(texts, encoder=None):
    column = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    flat, size = (encoder or S.PieceEncoder(VOCABULARY)).ids(*S._ready(column))
    return [x.tolist() for x in np.split(flat, np.cumsum(size)[:-1])]


letters = st.text(st.sampled_from("abeehtinor ▁  \nèä'.,日本\U0001f600\x00٣1290=()"), max_size=60)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.one_of(letters, st.text(max_size=20), st.text(st.sampled_from("aeinrst "), max_size=80)), min_size=1, max_size=6))
def test_ids_equal_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert ids_of(texts) == LIBRARY.encode(texts)


def test_spaces_beside_their_own_sign():
    texts = ["▁ ", " ▁", "▁▁ ▁a", "a ▁ b▁ c", "▁", " "]
    assert ids_of(texts) == LIBRARY.encode(texts)


def test_corpus_ids_equal_the_library():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    assert ids_of(texts) == LIBRARY.encode(texts)


def test_viterbi_equals_plain_loops():
    v = S.Vocabulary(PATH)
    v.bpe = False
    r = np.random.default_rng(3)
    v.score = -r.random(v.size) * 9 - 1
    v.lowest = v.score.min()
    names = {v.surface[i].decode().replace(" ", S.SPACE): i for i in v.ids.tolist()}
    for word in ("▁the", "▁unbelievably", "▁naïveté", "xx", "q", "日本the", "▁▁▁a"):
        sizes, flat = v.encode([word])
        best = [(0.0, [])] + [(-np.inf, [])] * len(word)
        for i in range(1, len(word) + 1):
            for j in range(max(0, i - 16), i):
                if (x := names.get(word[j:i])) is not None or i - j == 1:
                    gain = v.score[x] if x is not None else v.lowest - 10
                    ids = [x] if x is not None else v.bytes_[list(word[j:i].encode())].tolist()
                    if best[j][0] + gain > best[i][0]:
                        best[i] = (best[j][0] + gain, best[j][1] + ids)
        assert flat.tolist() == best[-1][1] and sizes.tolist() == [len(flat)]


def test_every_pair_of_some_pieces():
    r = np.random.default_rng(5)
    some = r.choice(VOCABULARY.ids[VOCABULARY.made[VOCABULARY.ids]], (3000, 2))
    ok = VOCABULARY.apart(some[:, 0], some[:, 1])
    for (a, b), x in zip(some.tolist(), ok.tolist()):
        text = LIBRARY.id_to_piece(a) + LIBRARY.id_to_piece(b)
        if not text.startswith(S.SPACE):
            continue
        assert (LIBRARY.encode(text[1:].replace(S.SPACE, " ")) == [a, b]) == x


def test_queries(spark):
    r = random.Random(6)
    vocab = ["the", "Wörter", "naïve", "日本語", "\U0001f600", "  ", "x" * 500, "1234", "don't", "\n"]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 5, 100])))) for i in range(80)]
    rows += [(3, "again"), (None, "no id"), (None, None), (100, ""), (101, " "), (102, "  lead"), (103, "word " * 50_000)]
    frame = spark.createDataFrame([(*x, "") for x in rows], SCHEMA).repartition(3)
    got = sorted((tuple(x) for x in S.digest(frame, PATH).collect()), key=str)
    want = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "")
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256((t or "").encode()).hexdigest(), True))
    assert got == sorted(want, key=str)
    ids = S.encode(frame.where("doc_id > 3"), PATH)
    assert {x["doc_id"]: x["text"] for x in S.decode(ids, PATH).collect()} == {i: t for i, t in rows if i is not None and i > 3}
    assert S.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), PATH).select("text").distinct().collect()[0][0] == ""


def test_empty_table(spark):
    assert S.digest(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    assert W is not None


def test_small_memory_gives_the_same():
    texts = [f"w{i} v{i % 7} é" for i in range(300)]
    small = S.PieceEncoder(VOCABULARY)
    small.remember = 50
    assert ids_of(texts, small) == ids_of(texts, small) == LIBRARY.encode(texts)


def test_texts_that_weak_hashes_confuse():
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    texts = ["".join("ab"[b] for b in bits[:n]) for n in (1024, 2048)] + ["".join("ba"[b] for b in bits[:n]) for n in (1024, 2048)]
    assert ids_of(texts, S.PieceEncoder(VOCABULARY)) == LIBRARY.encode(texts)


def test_workers_let_go_of_the_model(spark):
    def alive(batches):
        import gc

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(type(x).__name__ in ("PieceEncoder", "Vocabulary") for x in gc.get_objects())]})

    frame = spark.createDataFrame([(i, f"some words of {i}", "") for i in range(16)], SCHEMA).repartition(4)
    assert S.digest(frame, PATH).count() == 16 and len(S.digest(frame, PATH).collect()) == 16
    assert {x["n"] for x in spark.range(0, 64, 1, 16).mapInArrow(alive, "n long").collect()} == {0}
