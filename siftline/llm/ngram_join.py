"""Near duplicates by an exact Jaccard self-join of word n-grams: a grouped prefix join.

A document's set holds the hashes of its distinct n-word shingles. Documents of equal sets are one class.
Prefix filtering orders tokens: first the rare ones, with hashes in the lowest quarter that stand in fewer than
``HEAVY`` groups, by the number of groups they stand in; then the others. Classes of the same size and the same
low tokens form one group, which posts once; the lists of posted tokens bring together all groups whose prefixes
hold rare tokens only. The other classes (``short``) also post their prefixes in another order, all tokens by the
number of short classes they stand in, among themselves; so common passages come last in both orders.

A posting's place in its order bounds what two sets can share from there on, which drops most pairs that only
share a passage. So does a bitmap of 256 parities of each set's hashes: two of them differ in no more bits than the
sets have tokens that are not common, so more bits than linked sets may differ by rule a pair out. Candidates are verified on whole texts. First each list links its members to the one among them
that stands in most lists (in a group of edited copies that is the text they stem from), and a group its members
to its first, which is linear; after joining what these links connect, only pairs of a list that lie in different
components remain and are verified, so no link is lost and large groups of copies cost no square.

Defined cases: null texts and texts without words have no set and link with nothing; fewer than n words
count as one shingle; rows without an id get no component; rows of one id count as one document, which all of
their texts link; the component is the smallest id reachable. ASCII letter case doesn't count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _arrays as A
from ._common import fresh, partitions, staged, table, text_bytes
from .components import components

HEAVY = 64
LIST_BLOCK = 512
MAX_SENT = 1_000_000  # rows of three numbers that may be broadcast
LOW = 1 << 62  # hashes below are the low tokens
BITS = ["bits0", "bits1", "bits2", "bits3"]


def prefix(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """So many tokens of a set of ``n`` that a linked set shares one of its own prefix with them."""
    return n - (percent * n + 99) // 100 + 1


def _buckets(tokens: np.ndarray, n: int) -> np.ndarray:
    return ((tokens >> A.U(22)) % A.U(n)).astype(np.int64)


def parities(s: np.ndarray) -> np.ndarray:
    """For each of 256 classes of hashes, a bit: whether ``s`` holds an odd number of them."""
    return np.packbits((np.bincount((s & A.U(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).view(np.int64)


def _blobs(tokens: list[np.ndarray], groups: list[int], sizes: list[int], n_buckets: int) -> pa.RecordBatch | None:
    """Postings of several documents as a row for each bucket: tokens, and which group and size each has."""
    if not tokens or not sum(map(len, tokens)):
        return None
    token = np.concatenate(tokens)
    who = np.repeat(np.arange(len(tokens), dtype=np.int32), [len(t) for t in tokens])
    bucket = _buckets(token, n_buckets)
    order = np.argsort(bucket, kind="stable")
    token, who, bucket = token[order], who[order], bucket[order]
    start = np.flatnonzero(np.diff(bucket, prepend=-1))
    end = np.append(start[1:], len(bucket))
    g, s = np.array(groups, np.int64), np.array(sizes, np.int32)
    cols: list[list] = [[], [], [], []]
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        own, at = np.unique(who[a:b], return_inverse=True)
        for c, v in zip(cols, (int(bucket[a]), token[a:b].tobytes(), at.astype(np.int32).tobytes(), np.rec.fromarrays([g[own], s[own]], names="g,s").tobytes()), strict=True):
            c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "tokens", "who", "groups"])


_POSTINGS = "bucket int, tokens binary, who binary, groups binary"


def signatures(docs: DataFrame, k: int, n_buckets: int, percent: int) -> DataFrame:
    """A row for each document (its size, the 128-bit hash of its set and its group) and rows of postings."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = A.flat(batch.column("text"))
            n, n_low, h1, h2, gk = (np.zeros(len(batch), np.int64) for _ in range(5))
            bits = np.zeros((len(batch), len(BITS)), np.int64)
            posted, groups, sizes, met = [], [], [], set()
            known = batch.column("doc_id").is_valid().to_pylist()
            for i, j in A.slices(at):
                hashes, bounds = A.words(data[at[i] : at[j]], at[i : j + 1] - at[i])
                for row, s in enumerate(A.shingles(hashes, bounds, k), i):
                    if not len(s):
                        continue
                    low = s[: np.searchsorted(s, A.U(LOW))]
                    n[row], n_low[row] = len(s), len(low)
                    bits[row] = parities(s)
                    h1[row] = A.mix(s + A.U(1)).sum(dtype=A.U).astype(np.int64)
                    h2[row] = np.bitwise_xor.reduce(A.mix(s ^ A.U(0x5851F42D4C957F2D))).astype(np.int64)
                    # with fewer low tokens than a prefix, a class is a group of its own
                    alone = h1[row : row + 1].astype(A.U) if len(low) < prefix(len(s), percent) else np.zeros(1, A.U)
                    gk[row] = A.mix(alone + A.mix(low + A.U(7)).sum(dtype=A.U) + A.U(len(s)))[0].astype(np.int64)
                    if known[row] and (group := int(gk[row])) not in met:  # copies post once a batch
                        met.add(group)
                        posted.append(low)
                        groups.append(group)
                        sizes.append(len(s))
            m = len(batch)
            none = pa.nulls(m, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *map(pa.array, (n, n_low, h1, h2, gk, *np.ascontiguousarray(bits.T))), pa.nulls(m, pa.int32()), none, none, none], names)
            if (b := _blobs(posted, groups, sizes, n_buckets)) is not None:
                z = pa.nulls(len(b), pa.int64())
                yield pa.RecordBatch.from_arrays([z] * (7 + len(BITS)) + b.columns, names)

    names = ["doc_id", "key", "n", "low", "h1", "h2", "gk", *BITS, "bucket", "tokens", "who", "groups"]
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text").mapInArrow(cut, f"doc_id long, key long, n long, low long, h1 long, h2 long, gk long, {', '.join(f'{p} long' for p in BITS)}, {_POSTINGS}")


def _lists(rows: pa.Table | pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The postings of a bucket by token, size and group, each once."""
    token = np.concatenate([np.frombuffer(x, A.U) for x in rows.tokens])
    kind = np.dtype([("g", np.int64), ("s", np.int32)])
    who = np.concatenate([np.frombuffer(g, kind)[np.frombuffer(w, np.int32)] for w, g in zip(rows.who, rows.groups, strict=True)])
    order = np.lexsort((who["g"], who["s"], token))
    token, g, s = token[order], who["g"][order], who["s"][order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (g[1:] != g[:-1])
    return token[new], g[new], s[new]


def shared(postings: DataFrame, n_buckets: int, heavy: int | None) -> DataFrame:
    """The lists of two and more groups: a row for each posting (token, g, s; ``c``: the list's length); and, with no token, a row with the number of heavy tokens (``s``) of a group ``g``."""

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        token, g, s = _lists(rows)
        start = np.flatnonzero(np.diff(token, prepend=token[0] ^ A.U(1)) != 0)
        count = np.diff(np.append(start, len(token)))
        many = np.repeat(count, count)
        listed = (many > 1) & (many < (heavy or 1 << 62))
        out = [pd.DataFrame({"token": pd.array(token[listed].astype(np.int64), "Int64"), "g": g[listed], "s": s[listed], "c": many[listed]})]
        if heavy is not None:
            who, times = np.unique(g[many >= heavy], return_counts=True)
            out.append(pd.DataFrame({"token": pd.array([None] * len(who), "Int64"), "g": who, "s": times.astype(np.int32), "c": 0}))
        return pd.concat(out)

    return postings.repartition(n_buckets, "bucket").groupBy("bucket").applyInPandas(judge, "token long, g long, s int, c int")


def short_postings(texts: DataFrame, short: DataFrame, k: int, n_buckets: int) -> DataFrame:
    """The postings of all tokens of the classes in ``short`` (cid)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            posted = [_set(z, k) for z in rows.z]
            if (b := _blobs(posted, rows.cid.tolist(), [len(s) for s in posted], n_buckets)) is not None:
                yield b.to_pandas()

    return texts.join(short, "cid").select("cid", "z").mapInPandas(cut, _POSTINGS)


def _prefixes(lists: DataFrame, owner: str, rare: str, percent: int) -> DataFrame:
    """The postings (token, c, n, ...) within their owner's prefix, rarest first; ``r`` is the number of its tokens from there on. ``rare``: how many tokens the order has."""
    every = Window.partitionBy(owner)
    place = F.expr(rare) - F.count("*").over(every) + F.row_number().over(every.orderBy("c", "token")) - 1
    return lists.withColumn("r", F.col("n") - place).where(f"r >= ({percent} * n + 99) div 100")


def _alike(a: str, b: str, percent: int) -> str:
    """SQL: from their first common token on, sets ``a`` and ``b`` (columns n, r) hold enough tokens."""
    n, r = zip(*((c.replace("*", "n"), c.replace("*", "r")) for c in (a, b)), strict=True)
    return f"{100 + percent} * least({r[0]}, {r[1]}) >= {percent} * ({n[0]} + {n[1]})"


def _bits_alike(percent: int) -> str:
    """SQL: the bitmaps (BITS; of the other set with ``o`` before) differ in no more bits than linked sets do in tokens."""
    differ = " + ".join(f"bit_count({p} ^ o{p})" for p in BITS)
    return f"{100 + percent} * ({differ}) <= {100 - percent} * (n + n2)"


def _set(z: bytes, k: int) -> np.ndarray:
    data = np.frombuffer(zstandard.decompress(bytes(z)), np.uint8)
    hashes, bounds = A.words(data, np.array([0, len(data)]))
    return next(A.shingles(hashes, bounds, k))


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough."""
    left = texts.select(F.col("cid").alias("a"), F.col("z").alias("za"))
    right = texts.select(F.col("cid").alias("b"), F.col("z").alias("zb"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = lru_cache(256)(lambda z: _set(z, k))
        for rows in batches:
            ok = []
            for x, y in zip(rows.za, rows.zb, strict=True):
                x, y = cut(bytes(x)), cut(bytes(y))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    ok.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(both) - common))
            yield rows.loc[ok, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").select("a", "b", "za", "zb").mapInPandas(judge, "a long, b long")


def _packed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(cid, z): the compressed texts of some classes (cid, first, key)."""

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        c = zstandard.ZstdCompressor(1)
        return texts.map(lambda t: c.compress((t or "").encode()))

    keyed = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("first"), F.xxhash64("text").alias("key"), "text")
    if ids.limit(MAX_SENT + 1).count() <= MAX_SENT:  # 24 bytes a row: sent to the texts, which then stay where they are
        keyed = keyed.join(F.broadcast(ids), ["first", "key"]).select("cid", pack("text").alias("z"))
    else:
        keyed = keyed.select("first", "key", pack("text").alias("z")).join(ids, ["first", "key"]).select("cid", "z")
    return keyed.dropDuplicates(["cid"])


def _ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()


def _open(lists: DataFrame, classes: DataFrame, short: DataFrame, ids: DataFrame, part: DataFrame) -> DataFrame:
    """What the links, joined in ``part`` (cid, part), leave apart: (token, cid, n, r, part, m and bitmaps) for lists, and for groups that aren't short, of several components; ``m`` is the list's length."""
    members = staged(classes.join(ids, "cid").join(part, "cid", "left").select("gk", "cid", "n", *BITS, F.coalesce("part", "cid").alias("part")), "members")
    one = members.groupBy("gk").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("m"))
    by_group = lists.where("gk is not null").select("token", "gk", "r")
    still = by_group.join(one, "gk").groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("m").alias("m")).where("lo < hi").select("token", "m")
    entry = by_group.join(still, "token").join(members, "gk").select("token", "cid", "n", "r", "part", "m", *BITS)
    own = lists.where("gk is null").select("token", "cid", "r").join(members, "cid")
    still = own.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("token", "m")
    entry = entry.unionByName(own.join(still, "token").select("token", "cid", "n", "r", "part", "m", *BITS))
    inner = members.join(one.where("lo < hi").select("gk", "m"), "gk").join(short, "gk", "left_anti")
    return staged(entry.unionByName(inner.select(F.col("gk").alias("token"), "cid", "n", F.col("n").alias("r"), "part", "m", *BITS)), "open")


def _partners(entry: DataFrame, percent: int, seed: int | None) -> DataFrame:
    """Pairs of a list that lie in different components and may be alike: all, or those that fall in one of m / 2 random bins of the list.

    All pairs of a long list are looked at by blocks of ``LIST_BLOCK`` entries against each other, a task's share at
    a time; only pairs that sizes, places and bitmaps leave possible come out."""
    other = [F.col("cid").alias("c2"), F.col("n").alias("n2"), F.col("r").alias("r2"), F.col("part").alias("p2"), *(F.col(p).alias(f"o{p}") for p in BITS)]
    near = f"part < p2 and {_alike('*', '*2', percent)} and {_bits_alike(percent)}"
    if seed is None:
        blocks = F.expr(f"cast((m + {LIST_BLOCK - 1}) div {LIST_BLOCK} as int)")
        dealt = entry.withColumn("blocks", blocks).withColumn("own", F.expr("cast(pmod(xxhash64(cid, token), blocks) as int)"))
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        left = dealt.select("*", every.alias("x")).withColumn("y", F.col("own")).drop("own", "blocks", "m")
        right = dealt.select("token", F.col("own").alias("x"), every.alias("y"), *other)
        pairs = left.join(right, ["token", "x", "y"]).where(near)
    else:
        dealt = entry.withColumn("bin", F.pmod(F.xxhash64(F.lit(seed), "token", "cid"), F.greatest(F.expr("m div 2"), F.lit(1))))
        pairs = dealt.join(dealt.select("token", "bin", *other), ["token", "bin"]).where(near)
    return _ordered(pairs, "cid", "c2")


def _classes(rows: DataFrame) -> DataFrame:
    """The distinct sets, each with its first document and text, and an id: that document's, or a hash where it has several sets."""
    every = rows.where("n > 0 and doc_id is not null").groupBy("n", "low", "h1", "h2", "gk").agg(F.min(F.struct("doc_id", "key")).alias("m"), *(F.max(p).alias(p) for p in BITS))
    every = every.select("*", F.col("m.doc_id").alias("first"), F.col("m.key").alias("key")).drop("m")
    nth = F.row_number().over(Window.partitionBy("first").orderBy("n", "h1", "h2"))
    return every.withColumn("nth", nth).withColumn("cid", F.when(F.col("nth") == 1, F.col("first")).otherwise(F.xxhash64("first", "n", "h1", "h2"))).drop("nth")


def _same_document(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of an id whose rows have different texts."""
    some = rows.where("n > 0 and doc_id is not null")
    ids = some.groupBy("doc_id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("doc_id")
    own = some.join(ids, "doc_id", "left_semi").join(classes.select("n", "h1", "h2", "cid"), ["n", "h1", "h2"]).select("doc_id", "cid")
    least = own.groupBy("doc_id").agg(F.min("cid").alias("least"))
    return _ordered(own.join(least, "doc_id"), "cid", "least")


def _named(classes: DataFrame, part: DataFrame) -> DataFrame:
    """``part`` (cid, part) named by the smallest document; a class id that is a hash may be the smallest of a component."""
    hashed = classes.where("cid != first").select("cid")
    odd = part.join(hashed.withColumnRenamed("cid", "part"), "part", "left_semi")
    if hashed.isEmpty() or odd.isEmpty():
        return part
    least = odd.join(classes.select("cid", "first"), "cid").groupBy("part").agg(F.min("first").alias("least"))
    whole = part.union(odd.select(F.col("part").alias("cid"), "part").distinct())
    return whole.join(least, "part", "left").select("cid", F.coalesce("least", "part").alias("part"))


def _parts(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("b").alias("cid"), F.col("a").alias("part"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, class, component) of each row of ``docs``, and the verified links between classes."""
    spark = docs.sparkSession
    n_buckets = partitions(spark, text_bytes(docs))
    every = staged(signatures(docs, k, n_buckets, percent), "signatures")
    rows = every.where("bucket is null").select("doc_id", "key", "n", "low", "h1", "h2", "gk", *BITS)
    postings = every.where("bucket is not null").select("bucket", "tokens", "who", "groups")
    classes = staged(_classes(rows), "classes")
    found = staged(shared(postings, n_buckets, HEAVY), "lists")
    heavy = found.where("token is null").groupBy(F.col("g").alias("gk")).agg(F.sum("s").alias("heavy"))
    groups = classes.groupBy("gk").agg(F.min("cid").alias("rep"), F.max("n").alias("n"), F.max("low").alias("low"), F.count("*").alias("members"))
    groups = groups.join(heavy, "gk", "left").withColumn("rare", F.col("low") - F.coalesce("heavy", F.lit(0)))
    groups = staged(groups.select("gk", F.col("rep").alias("cid"), "n", "rare", "members"), "groups")
    lists = found.where("token is not null").select("token", F.col("g").alias("gk"), "c").join(groups, "gk")
    lists = staged(_prefixes(lists, "gk", "rare", percent).select("token", "gk", "cid", "n", "r"), "prefixes")
    # a group is short if its rare low tokens are fewer than its prefix
    short = groups.where(F.expr(f"rare < n - ({percent} * n + 99) div 100 + 1")).select("gk")
    some = lists.select("gk").union(short).union(groups.where("members > 1").select("gk")).distinct()
    ids = staged(classes.join(some, "gk").select("cid", "first", "key"), "class-ids")
    texts = staged(_packed(docs, ids), "texts")
    ids = ids.select("cid")
    own = shared(short_postings(texts, classes.join(short, "gk").select("cid"), k, n_buckets), n_buckets, None)
    own = _prefixes(own.select("token", F.col("g").alias("cid"), F.col("s").cast("long").alias("n"), "c"), "cid", "n", percent)
    own = own.select(F.xxhash64("token").alias("token"), F.lit(None).cast("long").alias("gk"), "cid", "n", "r")
    lists = lists.unionByName(staged(own, "short-lists"))
    # a list's centre is the text that stands in most lists
    placed = lists.join(lists.groupBy("cid").agg(F.count("*").alias("degree")), "cid")
    centre = placed.groupBy("token").agg(F.max(F.struct("degree", "cid", "n", "r")).alias("c"))
    across = placed.join(centre, "token").where(f"cid != c.cid and {_alike('*', 'c.*', percent)}").select(F.col("cid").alias("x"), F.col("c.cid").alias("y"))
    within = classes.join(groups.where("members > 1").select("gk", F.col("cid").alias("x")), "gk").select("x", F.col("cid").alias("y"))
    first = staged(_ordered(across.unionByName(within), "x", "y"), "pairs")
    links = staged(verified(first, texts, k, percent), "links")
    stars, tried = components(links.unionByName(_same_document(rows, classes))), first
    for seed in (1, None):  # a few partners of each text in each list, then all that are still apart
        entry = _open(lists, classes, short, ids, _parts(stars))
        second = _partners(entry, percent, seed).join(tried, ["a", "b"], "left_anti")
        second = staged(second, "open-pairs")
        new = staged(verified(second, texts, k, percent), "links")
        stars = components(stars.unionByName(new))
        links, tried = links.unionByName(new), tried.unionByName(second)
    part = _named(classes, _parts(stars))
    named = classes.join(part, "cid", "left").select("n", "h1", "h2", "first", F.coalesce("part", "cid").alias("part"))
    out = rows.join(named, ["n", "h1", "h2"], "left")
    return out.select("doc_id", "n", F.coalesce("first", "doc_id").alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("part", "doc_id")).alias("component_id")), links


def representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are first in their component, and those without a component."""
    doc_id, component = fresh(docs, "d", "component")
    found = near_duplicates(docs, k, percent)[0].where("doc_id > component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(found, docs["doc_id"].cast("long") == F.col(doc_id), "left_anti")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 4, 85)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")
