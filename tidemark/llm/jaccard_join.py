"""N-gram Jaccard join (op10): documents whose 4-word shingle sets overlap by 85 % or more, and the components of these links.

Grouped prefix join.

1. Documents with equal sets are one (128-bit signature; the smallest doc_id
   stands for them). A document with n shingles can only have a partner if at
   least ceil(0.85 n) of its shingles also stand in another set, which drops
   nearly all documents before any pair is formed, first on the shingles whose
   hash is below a fixed part of the range (at most n - ceil(0.85 n) of any subset
   may be unshared), then on all shingles.
2. The rest order their shingles from rare to frequent; two linked documents
   share one of their first n - ceil(0.85 n) + 1, the prefix. `groups`: documents
   with the same prefix and size collapse into one group, and only groups have
   rows in the list of a shingle.
3. `_meet`: groups that share a prefix shingle are paired, once however many they
   share. Pairs drop out whose sizes do not fit, whose members are in one
   component already, or whose odd sketches are too far apart: that of the most
   central member stands for a group, with the largest distance of a member from
   it as radius. `_expand`: the pairs that stay are expanded to members, whose
   own sketches must fit, and `verify` holds their whole texts against the rule.

Links inside large groups and long lists are not all expanded. Each group's
members are first verified against its most central one (whose shingles are the
most frequent), and each list's groups against the members of its most central
groups, in a few rounds that grow with the length of the list alone; then all
pairs that are still in different components are expanded and verified. No link
between components is lost, so the components are exact. Lists and groups of
more than PART rows are dealt to several tasks.

Shingles are compared by 64-bit hashes. Null, empty and blank texts have no
shingles and link with nothing; rows without doc_id are left out of the joins
and returned with a null component. Every row is a document of its own, also
where rows share a doc_id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .exchange import HOLD, beside, buckets, by_bucket, heads, pack, unpack
from .session import scratch, small_batches, stage

SIZE, NUMERATOR, DENOMINATOR = 4, 85, 100
_SMALL = 100  #: sets below this size are judged by all their shingles
SKETCH = 1024  #: bits of a set's odd sketch
ROUNDS = (4, 16)  #: central groups of each list that are tried before all pairs are
PART = 256  #: rows of a list or members of a group that one task takes


class Rule:
    """Link when den * intersection >= num * union."""

    def __init__(self, size: int = SIZE, num: int = NUMERATOR, den: int = DENOMINATOR):
        self.size, self.num, self.den = size, num, den
        #: the part of the hash range that is counted first: 4/3 of the part that may be unshared
        self.part = np.uint64(min((1 << 64) - 1, (1 << 64) * 4 * (den - num) // (3 * den)))

    def overlap(self, n):
        """The least intersection that a partner of a set of n needs."""
        return -(-n * self.num // self.den)

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        buf, offsets = W.buffers(column)
        for i, j in W.chunks(offsets):
            part, off = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            s, e, first = W.split(part, off, W.BLANK_SPLIT)
            words = W.hash_spans(part, s, e, W.LOWER)
            n = np.diff(first)
            count = np.where(n == 0, 0, np.maximum(n - self.size + 1, 1))
            edge = np.concatenate(([0], np.cumsum(count)))
            at = np.repeat(first[:-1] - edge[:-1], count) + np.arange(edge[-1])
            h = W.spans(words, at, np.minimum(self.size, np.repeat(first[1:], count) - at))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                x = np.sort(h[a:b])
                yield x[np.append(True, x[1:] != x[:-1])] if len(x) > 1 else x


def _signature(x: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(W.mix(x + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)), int(W.mix(x ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64).view(np.int64))


def _tally(token: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (token, owner) in order, and for each how many owners its token has; owner 0 says that there were several elsewhere."""
    order = np.lexsort([owner, token])
    token, owner = token[order], owner[order]
    new = heads(token, owner)
    token, owner = token[new], owner[new]
    head = heads(token)
    cls = np.cumsum(head) - 1
    n = np.bincount(cls)
    zero = np.zeros(len(n), bool)
    zero[cls[owner == 0]] = True
    return token, owner, np.where(zero, 2, n)[cls]


def _shared_counts(frame: DataFrame, rule: Rule, cut, short: bool) -> DataFrame:
    """(v, shared): how many of a set's tokens another set has too. frame: (v, text); cut(set): the tokens to send.

    A map task settles tokens that it sees in several sets itself, and sends
    one row that says so; a token in a third of all documents is then one row
    per task. short: tokens travel as 32 bits within their bucket, which can
    only count too many.
    """
    n = buckets(frame)
    few = max(1, n // 8)  # counts are small: fewer buckets, and so fewer blocks from each
    names = ["bucket", "token", "owner", "known", "count"]

    def flush(tokens: list[np.ndarray], owners: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, owner, many = _tally(np.concatenate(tokens), np.concatenate(owners))
        several = many > 1
        ids, count = np.unique(owner[several], return_counts=True)
        one = ~several | heads(token)
        token, owner = token[one], np.where(several[one], 0, owner[one])
        sent = (token >> np.uint64(32)).astype(np.uint32) if short else token
        a = pack((token % np.uint64(n)).astype(np.int32), {"token": sent, "owner": owner})
        b = pack((W.mix(ids.view(np.uint64)) % np.uint64(n)).astype(np.int32), {"known": ids, "count": count.astype(np.int64)})
        yield beside([a, b], names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owners, held = [], [], 0
        for batch in batches:
            for v, x in zip(batch.column("v").to_pylist(), rule.sets(batch.column("text")), strict=True):
                x = cut(x)
                tokens.append(x)
                owners.append(np.full(len(x), v, np.int64))
                held += len(x)
                if held >= HOLD:
                    yield from flush(tokens, owners)
                    tokens, owners, held = [], [], 0
        if held:
            yield from flush(tokens, owners)

    def count(table: pa.Table) -> pa.Table:
        _, owner, many = _tally(unpack(table, "token", "<u4" if short else "<u8"), unpack(table, "owner", "<i8"))
        ids, k = np.unique(owner[(many > 1) & (owner != 0)], return_counts=True)
        ids, k = np.concatenate((ids, unpack(table, "known", "<i8"))), np.concatenate((k, unpack(table, "count", "<i8")))
        return pa.Table.from_batches([pack((W.mix(ids.view(np.uint64)) % np.uint64(few)).astype(np.int32), {"v": ids, "n": k.astype(np.int64)})])

    def total(table: pa.Table) -> pa.Table:
        ids, at = np.unique(unpack(table, "v", "<i8"), return_inverse=True)
        return pa.table({"v": pa.array(ids), "shared": pa.array(np.bincount(at, unpack(table, "n", "<i8"), len(ids)).astype(np.int64))})

    sent = frame.mapInArrow(send, "bucket int, token binary, owner binary, known binary, count binary")
    return by_bucket(by_bucket(sent, count, "bucket int, v binary, n binary", n), total, "v long, shared long", few)


def _odd(token: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """For each set, SKETCH bits: whether an odd number of its tokens falls on the bit. Two sets differ in at least as many tokens as their sketches in bits."""
    bit, out = (W.mix(token ^ np.uint64(0x5DEECE66D)) % np.uint64(SKETCH)).astype(np.int64), []
    for a in range(0, len(start), 1024):
        n = length[a : a + 1024]
        part = bit[start[a] : start[a] + n.sum()]
        count = np.bincount(np.repeat(np.arange(len(n)), n) * SKETCH + part, minlength=len(n) * SKETCH)
        out.append(np.packbits((count & 1).astype(np.uint8), bitorder="little").view(np.int64))
    flat = np.concatenate(out) if out else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, SKETCH // 64), pa.int32()), pa.array(flat))


def _prefixes(kept: DataFrame, rule: Rule) -> DataFrame:
    """One row for each set: v, n (its size), prefix (its rare-first prefix, without tokens that no other has), g and t (hashes of the whole prefix and size), q (how many sets hold its tokens, on average), o (its odd sketch)."""
    n = buckets(kept)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(rule.sets(batch.column("text")))
            size = np.array([len(x) for x in found], np.int64)
            token = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pack((token % np.uint64(n)).astype(np.int32), {"token": token, "v": np.repeat(np.asarray(batch.column("v")).astype(np.int64), size), "size": np.repeat(size, size).astype(np.int32)})

    def frequency(table: pa.Table) -> pa.Table:
        token, v, size = unpack(table, "token", "<u8"), unpack(table, "v", "<i8"), unpack(table, "size", "<i4")
        _, at, count = np.unique(token, return_inverse=True, return_counts=True)
        return pa.Table.from_batches([pack((W.mix(v.view(np.uint64)) % np.uint64(max(1, n // 4))).astype(np.int32), {"token": token, "v": v, "size": size, "df": count[at].astype(np.int32)})])

    def choose(table: pa.Table) -> pa.Table:
        token, v, size, df = (unpack(table, c, k) for c, k in (("token", "<u8"), ("v", "<i8"), ("size", "<i4"), ("df", "<i4")))
        order = np.lexsort([token, df, v])
        token, v, size, df = token[order], v[order], size[order].astype(np.int64), df[order]
        start = np.flatnonzero(heads(v))
        length = np.diff(np.append(start, len(v)))
        take = np.arange(len(v)) - np.repeat(start, length) < size - rule.overlap(size) + 1
        if not len(start):
            return _PREFIXES.empty_table()
        g, t = (W.mix(np.add.reduceat(np.where(take, W.mix(token * np.uint64(2 * k + 1) + np.uint64(11 + k)), np.uint64(0)), start) + size[start].view(np.uint64)) for k in (0, 1))
        q = np.add.reduceat(df.astype(np.float64), start) / length
        take &= df > 1
        flat = np.concatenate(([0], np.cumsum(np.add.reduceat(take, start))))
        prefix = pa.ListArray.from_arrays(pa.array(flat, pa.int32()), pa.array(token[take].view(np.int64)))
        return pa.Table.from_arrays([pa.array(v[start]), pa.array(size[start]), prefix, pa.array(g.view(np.int64)), pa.array(t.view(np.int64)), pa.array(q), _odd(token, start, length)], schema=_PREFIXES)

    sent = kept.mapInArrow(send, "bucket int, token binary, v binary, size binary")
    back = by_bucket(sent, frequency, "bucket int, token binary, v binary, size binary, df binary", n)
    return by_bucket(back, choose, "v long, n long, prefix array<long>, g long, t long, q double, o array<long>", max(1, n // 4))


_PREFIXES = pa.schema([("v", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("g", pa.int64()), ("t", pa.int64()), ("q", pa.float64()), ("o", pa.list_(pa.int64()))])


def verify(pairs: DataFrame, kept: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of sets of kept (v, text) that link, by their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(rule.sets(batch.column("ta")), rule.sets(batch.column("tb")), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both > 0 and rule.den * both >= rule.num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    a = kept.select(F.col("v").alias("a"), F.col("text").alias("ta"))
    b = kept.select(F.col("v").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _sizes(rule: Rule):
    return F.lit(rule.den) * F.least("nx", "ny") >= F.lit(rule.num) * F.greatest("nx", "ny")


def _apart(a, b):
    """In how many bits two sketches differ."""
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(SKETCH // 64)), F.lit(0))


def _fits(rule: Rule, radius=None):
    """Whether (nx, ox) and (ny, oy) may link: sizes fit, and the sketches (less the radius) do not differ in more bits than linked sets differ in tokens."""
    differ = _apart(F.col("ox"), F.col("oy"))
    if radius is not None:
        differ = F.greatest(differ - radius, F.lit(0))
    n = F.col("nx") + F.col("ny")
    # den * both >= num * (n - both), and differ <= n - 2 * both
    return _sizes(rule) & (F.lit(rule.num + rule.den) * (n - differ) >= F.lit(2 * rule.num) * n)


def _dealt(frame: DataFrame, by: str, parts) -> DataFrame:
    """frame with its part of a list or group: a hash of `by`, below parts."""
    return frame.withColumn("part", F.pmod(F.xxhash64(by), parts).cast("int"))


def _each(frame: DataFrame, parts) -> DataFrame:
    """frame once for every part."""
    return frame.withColumn("part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))


def _parts(count):
    return F.floor(count / PART) + 1


def groups(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From _prefixes, the groups of sets with the same prefix and size (g, n, prefix, parts; q, v and o of the most central member, radius), and their members (g, v, n, o, parts)."""
    one = sets.groupBy("g", "t").agg(F.min("v").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), _parts(F.count("*")).alias("parts"), F.max(F.struct("q", "v", "o")).alias("lead"))
    one = stage(one, "groups")
    members = sets.select("g", "t", "v", "n", "o").join(one.select("g", "t", "id", "parts", F.col("lead.o").alias("center")), ["g", "t"])
    members = stage(members.select(F.col("id").alias("g"), "v", "n", "o", "parts", _apart(F.col("o"), F.col("center")).alias("d")), "members")
    radius = members.groupBy("g").agg(F.max("d").alias("radius"))
    heads_ = one.select(F.col("id").alias("g"), "n", "prefix", "parts", F.col("lead.q").alias("q"), F.col("lead.v").alias("v"), F.col("lead.o").alias("o"))
    return stage(heads_.join(radius, "g"), "heads"), members.drop("d")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """members with the component c of each."""
    return members.withColumn("c", F.col("v")) if labels is None else members.join(labels, "v", "left").withColumn("c", F.coalesce("c", "v"))


def _live(heads_: DataFrame, labelled: DataFrame) -> DataFrame:
    """Lists whose groups are in several components: token, g, n, q, o, radius, lo and hi (least and greatest component of the group's members), split (parts of the list)."""
    at = heads_.join(labelled.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")), "g")
    at = at.select(F.explode("prefix").alias("token"), "g", "n", "q", "o", "radius", "lo", "hi")
    mixed = at.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h"), _parts(F.count("*")).alias("split")).where("l < h").select("token", "split")
    return _dealt(at, "g", F.lit(16)).join(_each(mixed, F.lit(16)), ["token", "part"]).drop("part")


def _meet(one: DataFrame, live: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (x, y, and y's lo and hi) of groups of one and of live in the same list that may have members that link and are not all in one component."""
    x = _each(one, F.col("split")).select("token", "part", F.col("g").alias("x"), F.col("n").alias("nx"), F.col("o").alias("ox"), F.col("radius").alias("rx"), F.col("lo").alias("lx"), F.col("hi").alias("hx"))
    y = _dealt(live, "g", F.col("split")).select("token", "part", F.col("g").alias("y"), F.col("n").alias("ny"), F.col("o").alias("oy"), F.col("radius").alias("ry"), "lo", "hi")
    fits = (F.least("lo", "lx") < F.greatest("hi", "hx")) & _fits(rule, F.col("rx") + F.col("ry"))
    return y.join(x, (x["token"] == y["token"]) & (x["part"] == y["part"]) & fits).select("x", "y", "lo", "hi").distinct()


def _central(live: DataFrame, k: int) -> DataFrame:
    """The k most central groups of each list."""
    best = live.select("token", "g", "q")
    for parts in (64, 8, 1):  # a long list is cut down in parts
        keys = [F.col("token"), F.pmod("g", F.lit(parts))]
        best = best.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("q"), "g"))).where(F.col("r") <= k).drop("r")
    return live.join(best.select("token", "g"), ["token", "g"])


def _outside(live: DataFrame) -> DataFrame:
    """Groups of each list that are not wholly in its largest component."""
    size = live.where("lo = hi").groupBy("token", "lo").agg(F.count("*").alias("k"))
    main = size.groupBy("token").agg(F.max_by("lo", F.struct("k", "lo")).alias("main"))
    at = _dealt(live, "g", F.lit(16)).join(_each(main, F.lit(16)), ["token", "part"], "left").drop("part")
    return at.where("main IS NULL OR lo < hi OR lo <> main").drop("main")


def _expand(pairs: DataFrame, some: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of members of group pairs (x, y) that are in different components and may link: of x the members in `some`, of y all. Both: g, v, n, o, c, parts."""
    split = members.select("g", "parts").where("parts > 1").distinct()
    many = pairs.join(split.select(F.col("g").alias("x"), F.col("parts").alias("px")), "x", "left").join(split.select(F.col("g").alias("y"), F.col("parts").alias("py")), "y", "left")
    named = lambda m, z: _dealt(m, "v", F.col("parts")).select(F.col("g").alias(z), "part", F.col("v").alias(f"v{z}"), F.col("c").alias(f"c{z}"), F.col("n").alias(f"n{z}"), F.col("o").alias(f"o{z}"))
    a = _each(many, F.coalesce("px", F.lit(1)))
    b = named(some, "x")
    left = a.join(b, (a["x"] == b["x"]) & (a["part"] == b["part"]) & ((F.col("cx") != F.col("lo")) | (F.col("cx") != F.col("hi")))).select(b["x"], "y", "py", "vx", "cx", "nx", "ox")
    a = _each(left, F.coalesce("py", F.lit(1)))
    b = named(members, "y")
    both = a.join(b, (a["y"] == b["y"]) & (a["part"] == b["part"]) & (F.col("cx") != F.col("cy")) & _fits(rule))
    return both.select(F.least("vx", "vy").alias("a"), F.greatest("vx", "vy").alias("b")).distinct()


def _linked(maybe: DataFrame, one: DataFrame, rule: Rule) -> DataFrame:
    """(v, c): the component of each set of maybe (v, text) that links with another. one: the sizes n of the sets w."""
    spare = F.col("n") - F.ceil(F.col("n") * rule.num / rule.den)
    full = _shared_counts(maybe, rule, lambda x: x, False)
    fair = full.join(one.select(F.col("w").alias("v"), "n"), "v").where(F.col("shared") >= F.col("n") - spare).select("v")
    kept = stage(maybe.join(fair, "v"), "kept")

    heads_, members = groups(stage(_prefixes(kept, rule), "prefixes"))
    lead = heads_.select("g", "v")
    links = tried = labels = None
    for k in (1, *ROUNDS, None):
        labelled = _labelled(members, labels)
        live = stage(_live(heads_, labelled), "live")
        own = labelled.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select(F.col("g").alias("x"), F.col("g").alias("y"), "lo", "hi")  # members of one group
        if labels is not None and live.isEmpty() and own.isEmpty():
            break
        pairs = _meet(_central(live, k) if k else _outside(live), live, rule)
        if k != ROUNDS[0]:
            pairs = pairs.unionByName(own).distinct()
        new = _expand(pairs, labelled.join(lead, ["g", "v"]) if k else labelled, labelled, rule)
        new = stage(new if tried is None else new.join(tried, ["a", "b"], "left_anti"), "pairs")
        found = stage(verify(new, kept, rule), "links")
        tried = new if tried is None else tried.unionByName(new)
        if links is None or not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = components(links)
    return labels


def near(docs: DataFrame, size: int = SIZE, num: int = NUMERATOR, den: int = DENOMINATOR, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text). row: a long column of docs that is returned too, with c, a number of the row's own component (null without doc_id or shingles)."""
    rule = Rule(size, num, den)
    extra = [row] if row else []
    docs = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *extra)
    reach = -(-_SMALL * den // num)
    cut = lambda x: x if len(x) < reach else x[: np.searchsorted(x, rule.part)]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(x), len(x) if len(x) < _SMALL else int(np.searchsorted(x, rule.part)), *_signature(x)) for x in rule.sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *extra)), *(pa.array([x[k] for x in found], pa.int64()) for k in range(4))], ["doc_id", *extra, "n_shingles", "n_sampled", "v", "t"])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_signature(x)[0] for x in rule.sets(batch.column("text"))], pa.int64()), batch.column("text")], ["v", "text"])

    every = stage(docs.mapInArrow(describe, f"doc_id long, {''.join(f'{c} long, ' for c in extra)}n_shingles long, n_sampled long, v long, t long"), "sizes")
    one = every.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("v", "t").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.max("n_sampled").alias("m"))
    twin = F.row_number().over(Window.partitionBy("v").orderBy("t"))  # sets with one v have different numbers w
    one = stage(one.withColumn("w", F.when(twin == 1, F.col("v")).otherwise(F.xxhash64("v", "t"))), "sets")
    spare = F.col("n") - F.ceil(F.col("n") * num / den)

    shared = _shared_counts(docs.where("doc_id IS NOT NULL").select("text").mapInArrow(signed, "v long, text string"), rule, cut, True)
    fair = one.join(shared, "v", "left").where(F.coalesce("shared", F.lit(0)) >= F.col("m") - spare)
    maybe = docs.join(fair.select(F.col("rep").alias("doc_id"), "v", "t", "w"), "doc_id").select("v", "t", "w", "text")

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signature(x) for x in rule.sets(batch.column("text"))]
            same = pc.and_(*(pc.equal(pa.array([x[k] for x in found], pa.int64()), batch.column(c)) for k, c in enumerate("vt")))
            yield pa.RecordBatch.from_arrays([batch.column("w"), batch.column("text")], ["v", "text"]).filter(same)

    with scratch(docs.sparkSession):
        maybe = stage(maybe.mapInArrow(matched, "v long, text string").dropDuplicates(["v"]), "maybe")
        labels = stage(_linked(maybe, one, rule), "components", outlives=True)
    member = one.select("v", "t", "w", "rep").join(labels.withColumnRenamed("v", "w"), "w", "left").withColumn("c", F.coalesce("c", "w"))
    least = member.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = member.join(least, "c").select("v", "t", "component_id", *(["c"] if row else []))
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    more = [*extra, F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("c")] if row else []
    return every.join(named, ["v", "t"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"), *more)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(spark.read.parquet(f"{sf_dir}/documents.parquet"))
