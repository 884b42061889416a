"""Benchmark decontamination (op5): training text that repeats test items.

A generalised suffix automaton of the normalised test items (A-Z to a-z, words
of letters, digits and non-ASCII characters) reads each document's words and
tracks the longest match that ends at each word. Where the match is at least a
window long (13 words, or all words of a shorter item), the window's words are
hit, and the automaton's state tells which items hold it. Runs of words no two
neighbours of which are neighbours in an item can hold no window of two words
or more; a bitmap of the items' word pairs skips them, so only possible matches
are stepped through. Words are compared by 64-bit hashes.

The benchmark is counted first. Up to SHARD_WORDS words one automaton is
broadcast; a larger benchmark is dealt into automata of about that size (an
item longer than that is one automaton by itself), and each document passes
through them one after the other. At most ABREAST automata are on the executors
at a time: a benchmark of more is read in several passes, each of which writes
the hit words and items of its rows, and these are joined in the end.

Null and empty texts have no words and no hits. Null item texts, and items
without words, match nothing; rows of the benchmark that repeat an item_id are
one item with several texts. Null item_ids are left out. Extra columns of
documents pass through `clean` and `spans`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import words as W
from .session import plain_names, small_batches, stage

WINDOW = 13
SHARD_WORDS = 400_000  #: words of test items in one automaton
ABREAST = 8  #: automata that are broadcast at a time
COVERAGE = 20  #: a document is contaminated if COVERAGE * hit words >= words
_BITS = 22
_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    buf, offsets = W.buffers(texts)
    s, e, first = W.split(buf, offsets, W.ALNUM)
    return buf, s, e, first, W.hash_spans(buf, s, e, W.LOWER)


def _pairs(h: np.ndarray) -> np.ndarray:
    """Numbers of _BITS bits for neighbours h[i], h[i + 1]."""
    return ((h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - _BITS)).astype(np.int64)


class Automaton:
    """All substrings of all items; each state knows the longest string it stands for."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW):
        self.window = window
        self.names = sorted({k for k, h in items if len(h)})
        number = {k: i for i, k in enumerate(self.names)}
        items = [(number[k], h) for k, h in items if len(h)]
        every = np.concatenate([h for _, h in items]) if items else np.zeros(0, np.uint64)
        self.vocabulary = np.unique(every)
        self.least = min([window, *(len(h) for _, h in items)])
        self.pairs, self.single = np.zeros(1 << _BITS, bool), np.zeros(1 << _BITS, bool)
        self.single[(every >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.length, self.link, self.next = [0], [-1], [{}]
        ends: dict[int, set[int]] = {}
        for item, h in items:
            self.pairs[_pairs(h)] = True
            last = 0
            for n, w in enumerate(np.searchsorted(self.vocabulary, h).tolist(), 1):
                last = self._extend(last, w)
                if n >= window:
                    ends.setdefault(last, set()).add(item)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for v in order:  # what ends in a state ends in all its suffixes
            if v in ends and self.length[up := self.link[v]] >= window:
                ends.setdefault(up, set()).update(ends[v])
        #: of a state, the windows that are suffixes of its string: (words, items)
        self.marks: dict[int, list[tuple[int, frozenset[int]]]] = {v: [(window, frozenset(x))] for v, x in ends.items() if self.length[self.link[v]] < window}
        short: dict[tuple[int, int], set[int]] = {}
        for item, h in items:
            if len(h) < window:
                v = 0
                for w in np.searchsorted(self.vocabulary, h).tolist():
                    v = self.next[v][w]
                short.setdefault((v, len(h)), set()).add(item)
        for (v, n), x in short.items():
            self.marks.setdefault(v, []).append((n, frozenset(x)))
        #: the nearest state at or above that has marks
        self.near = [-1] * len(self.length)
        for v in reversed(order):
            self.near[v] = v if v in self.marks else self.near[self.link[v]]

    def _state(self, length: int, link: int, follow: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(follow)
        return len(self.length) - 1

    def _extend(self, last: int, w: int) -> int:
        """The state of the string of `last` and the word w."""
        if (q := self.next[last].get(w)) is not None:  # another item has this string
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        part = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = part
            p = self.link[p]
        self.link[q] = part
        return part

    def runs(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word ranges that may hold a window: [start, stop)."""
        n = len(h)
        if not n or not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined = np.zeros(n + 1, bool)  # joined[i]: words i - 1 and i may be neighbours in an item
        joined[1:n] = self.pairs[_pairs(h)]
        joined[first] = False
        step = np.diff(joined.astype(np.int8))
        if self.least > 1:
            start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + 1
            keep = stop - start >= self.least
            return start[keep], stop[keep]
        start = np.flatnonzero(~joined[:-1])
        stop = np.append(start[1:], n)
        known = np.logical_or.reduceat(self.single[(h >> np.uint64(64 - _BITS)).astype(np.int64)], start)
        return start[known], stop[known]

    def read(self, h: np.ndarray, hit: np.ndarray, base: int) -> set[int]:
        """Step through one run; mark what is hit, return the items."""
        at = np.searchsorted(self.vocabulary, h)
        at[at == len(self.vocabulary)] = 0
        ids = np.where(self.vocabulary[at] == h, at, -1).tolist()
        follow, link, length, near, marks = self.next, self.link, self.length, self.near, self.marks
        found, v, n = set(), 0, 0
        for i, w in enumerate(ids, base + 1):
            while v and w not in follow[v]:
                v = link[v]
                n = length[v]
            v = follow[v].get(w, 0) if w >= 0 else 0
            n = n + 1 if v else 0
            u = near[v] if v else -1
            while u > 0:
                for size, items in marks[u]:
                    if size <= n:
                        hit[i - size : i] = True
                        found |= items
                u = near[link[u]] if link[u] > 0 else -1
        return found

    def scan(self, h: np.ndarray, first: np.ndarray, hit: np.ndarray) -> dict[int, set[int]]:
        """Mark hit words of a chunk; the items of each text that has some."""
        out: dict[int, set[int]] = {}
        for a, b in zip(*(x.tolist() for x in self.runs(h, first)), strict=True):
            if found := self.read(h[a:b], hit, a):
                out.setdefault(int(np.searchsorted(first, a, "right")) - 1, set()).update(found)
        return out


def prepared(docs: DataFrame, benchmark: DataFrame, window: int, shard_words: int) -> tuple[DataFrame, list]:
    """docs (with text), and the broadcast automata that its rows have to pass. A benchmark of many automata has been passed already: the rows then have their _spans and _items, and no automata are left."""
    spark = small_batches(docs).sparkSession
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("k"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.size(F.regexp_extract_all(F.lower("text"), F.lit(_PATTERN), F.lit(0)))).alias("n")).first()["n"] or 0
    n = max(1, -(-int(total) // shard_words))

    def machines(shards: range) -> list:
        out = []
        for k in shards:
            rows = (items.where(F.pmod(F.xxhash64("k"), F.lit(n)) == k) if n > 1 else items).toArrow()
            if len(rows):
                *_, first, h = hashed_words(rows.column("text"))
                out.append(spark.sparkContext.broadcast(Automaton([(name, h[a:b]) for name, a, b in zip(rows.column("k").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True)], window)))
        return out

    if n <= ABREAST:
        return docs, machines(range(n))
    docs = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = None
    for at in range(0, n, ABREAST):
        some = machines(range(at, min(at + ABREAST, n)))

        def run(batches: Iterator[pa.RecordBatch], some: list = some) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, _, _, _, first, hit, names in _scanned(batch, some):
                    at = sorted(names)
                    yield pa.RecordBatch.from_arrays([rows.column("_row").take(pa.array(at, pa.int64())), pa.array([_runs(hit[first[i] : first[i + 1]]) for i in at], _SPANS), pa.array([sorted(names[i]) for i in at], pa.list_(pa.string()))], ["_row", "_spans", "_items"])

        hits = stage(docs.select("_row", "text").mapInArrow(run, "_row long, _spans array<struct<start: long, stop: long>>, _items array<string>"), "hits")
        found = hits if found is None else found.unionByName(hits)
        for x in some:
            x.destroy()
    told = found.groupBy("_row").agg(F.flatten(F.collect_list("_spans")).alias("_spans"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"))
    return docs.join(told, "_row", "left").drop("_row"), []


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _runs(hit: np.ndarray) -> list[dict]:
    """[start, stop) of the runs of hit words."""
    edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
    return [{"start": int(x), "stop": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)]


def _scanned(batch: pa.RecordBatch, machines: list) -> Iterator[tuple]:
    """Chunks: rows, bytes, word starts, ends, first words, hit words, names of items by row."""
    told = "_spans" in batch.schema.names
    buf, offsets = W.buffers(batch.column("text"))
    for i, j in W.chunks(offsets):
        part, off = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        s, e, first = W.split(part, off, W.ALNUM)
        h = W.hash_spans(part, s, e, W.LOWER)
        hit, names = np.zeros(len(h), bool), {}
        for m in machines:
            a = m.value
            for row, found in a.scan(h, first, hit).items():
                names.setdefault(row, set()).update(a.names[x] for x in found)
        rows = batch.slice(i, j - i)
        if told:
            for k, (spans, found) in enumerate(zip(rows.column("_spans").to_pylist(), rows.column("_items").to_pylist(), strict=True)):
                for x in spans or ():
                    hit[first[k] + x["start"] : first[k] + x["stop"]] = True
                if found:
                    names[k] = set(found)
            rows = rows.select([c for c in rows.schema.names if c not in ("_spans", "_items")])
        yield rows, part, s, e, first, hit, names


def _counts(first: np.ndarray, hit: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(hit)))
    return sums[first[1:]] - sums[first[:-1]]


def digest(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    docs, machines = prepared(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), benchmark, window, shard_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for rows, _, _, _, first, hit, names in _scanned(batch, machines):
                n, k = np.diff(first), _counts(first, hit)
                sha = [none] * len(rows)
                for row, x in names.items():
                    sha[row] = hashlib.sha256(",".join(sorted(x)).encode()).hexdigest()
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array([len(names.get(i, ())) for i in range(len(rows))], pa.int64()), pa.array(sha, pa.string()), pa.array((k > 0) & (COVERAGE * k >= n))],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return docs.mapInArrow(run, schema)


def spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of docs, and spans (array of [start, stop) word numbers that are hit), items (array of item_ids), hit_words, all_words; columns of docs with these names are replaced."""
    docs = docs.drop(*_EXTRA)
    named, plain = [*docs.columns, *_EXTRA], plain_names(docs, "text")
    docs, machines = prepared(plain, benchmark, window, shard_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _, _, first, hit, names in _scanned(batch, machines):
                where = [_runs(hit[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                extra = [pa.array(where, _SPANS), pa.array([sorted(names.get(i, ())) for i in range(len(rows))], pa.list_(pa.string())), pa.array(_counts(first, hit), pa.int64()), pa.array(np.diff(first), pa.int64())]
                yield pa.RecordBatch.from_arrays([*rows.columns, *extra], [*rows.schema.names, *_EXTRA])

    return docs.mapInArrow(run, StructType([*plain.schema.fields, *StructType.fromDDL("spans array<struct<start: long, stop: long>>, items array<string>, hit_words long, all_words long").fields])).toDF(*named)


_EXTRA = ("spans", "items", "hit_words", "all_words")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs without the contaminated rows (coverage limit); from the others, hit spans are cut. Texts without hits stay as they are."""
    named, plain = docs.columns, plain_names(docs, "text")
    docs, machines = prepared(plain, benchmark, window, shard_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, part, s, e, first, hit, _ in _scanned(batch, machines):
                n, k = np.diff(first), _counts(first, hit)
                texts = rows.column("text").to_pylist()
                for i in np.flatnonzero((k > 0) & (COVERAGE * k < n)).tolist():
                    a, b = int(first[i]), int(first[i + 1])
                    edge = np.flatnonzero(np.diff(hit[a:b].astype(np.int8), prepend=0, append=0)) + a
                    raw, shift = texts[i].encode(), int(s[a]) - _lead(texts[i].encode())
                    cuts = [(int(s[x]) - shift, int(e[y - 1]) - shift) for x, y in zip(edge[::2], edge[1::2], strict=True)]
                    stops = [0, *(y for _, y in cuts)]
                    texts[i] = b"".join(raw[p:q] for p, q in zip(stops, [*(x for x, _ in cuts), len(raw)], strict=True)).decode()
                columns = [pa.array(texts, c.type) if name == "text" else c for name, c in zip(rows.schema.names, rows.columns, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, rows.schema.names).filter(pa.array(~((k > 0) & (COVERAGE * k >= n))))

    return docs.mapInArrow(run, plain.schema).toDF(*named)


def _lead(raw: bytes) -> int:
    """Bytes before the first word."""
    return int(np.argmax(W.ALNUM[np.frombuffer(raw, np.uint8)]))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
