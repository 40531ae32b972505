"""Conversation prefix trie: the distinct openings of conversations, with what their subtrees hold.

Each turn is a hash of role and text, each prefix the running exclusive-or of 128-bit hashes of place and turn, and
a trie's node the prefix's hash with its depth. Every task adds up its own conversations to a partial trie, a table
of nodes; groups of ``FAN_IN`` tasks merge their tables by hash, then groups of groups, until one trie is left:
members are summed, the smallest one names the node. The lists of conversations that end at a node merge as
sorted pieces, each of a range of ids.

The bottom-up rollup needs no step for each level: a node is owned by its smallest member, so the nodes that a
conversation owns are the last ones of its path. Their sums, from the end up, are what it adds to each of its
prefixes, and all that conversations add to a node is the sum over its subtree. Conversations of any length are
worked on in stretches of ``STRETCH`` turns.

Defined cases: turns go by number, null first, then by the md5 of role and text; null role or text is empty; rows without a
conversation id belong to none; repeated rows are turns each; other columns are not read; an empty table
gives no nodes, as there is no conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import WORD, hot, spread, staged, table

FAMILY = 20  # conversations that share an opening: those from a multiple of it on
FAN_IN = 16
STRETCH = 1024
PIECE = 4096  # ids of a piece of an end list, about


def running(rows: DataFrame, part: Column, order: list[Column], **totals: tuple[str, str]) -> DataFrame:
    """``rows`` with running totals in each conversation: ``name=(column, how)``, how being sum or xor.

    ``part`` cuts a conversation into stretches that follow each other as its value grows; ``order`` is that in a stretch."""
    how = {"sum": (F.sum, lambda a, b: a + b), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}
    cut = rows.withColumn("part", part)
    inside = Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = cut.groupBy("conv_id", "part").agg(*(how[h][0](c).alias(n) for n, (c, h) in totals.items()))
    below = whole.select("conv_id", "part", *(F.coalesce(how[h][0](n).over(before), F.lit(0)).alias(f"below_{n}") for n, (_, h) in totals.items()))
    own = cut.select("*", *(how[h][0](c).over(inside).alias(f"own_{n}") for n, (c, h) in totals.items()))
    both = own.join(below, ["conv_id", "part"])
    return both.select(*rows.columns, *(how[h][1](F.col(f"own_{n}"), F.col(f"below_{n}")).alias(n) for n, (_, h) in totals.items()))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_hash, words): each conversation's turns from 1 on."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("turn_hash"),
        F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("words"), F.lit(1).cast("long").alias("one"),
    )
    part = F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 62)))
    out = running(staged(rows, "trie-turns"), part, [F.col("turn").asc_nulls_first(), F.col("turn_hash")], pos=("one", "sum"))
    return out.select("conv_id", "pos", "turn_hash", "words")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The turns (conv_id, depth, turn_hash, words) of rebuilt conversations, their sizes (conv_id, n), and the long ones as ``hot`` gives them.

    The first h turns of a conversation are replaced by those of the first one of its family."""
    family = lambda c: c - c % FAMILY
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    sizes = sizes.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string")) % 4).alias("h"), family(F.col("conv_id")).alias("base"))
    bases = sizes.where("conv_id = base").select("base", F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    sizes = staged(sizes.join(bases, "base", "left").select("conv_id", "n", "h", "base", taken.alias("taken")), "trie-sizes")
    long_ = hot(sizes.select("conv_id", "n"), "conv_id", sizes.agg(F.sum("n")).first()[0] or 0)
    own = spread(rows, sizes.select("conv_id", "h", "taken"), "conv_id", ["pos"], long_).where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "turn_hash", "words")
    # at most three turns of a family's first conversation go to its twenty
    given = rows.where((F.col("conv_id") == family(F.col("conv_id"))) & (F.col("pos") <= 3)).select(F.col("conv_id").alias("base"), "pos", "turn_hash", "words")
    given = sizes.where("taken > 0").select("conv_id", "base", "taken").join(given, "base").where("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "turn_hash", "words")
    return own.unionByName(given), sizes.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), long_


def _key(depth: Column, a: Column, b: Column) -> Column:
    return F.concat_ws(".", depth.cast("string"), F.hex(a), F.hex(b))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent, words): the nodes that each conversation passes, but for the root."""
    salted = lambda i: F.xxhash64(F.lit(i), "depth", "turn_hash")
    rows = turns.select("*", salted(1).alias("x1"), salted(2).alias("x2"))
    out = running(staged(rows, "trie-rebuilt"), F.floor(F.col("depth") / STRETCH), [F.col("depth")], h1=("x1", "xor"), h2=("x2", "xor"))
    d, h1, h2 = F.col("depth"), F.col("h1"), F.col("h2")
    return out.select("conv_id", "depth", _key(d, h1, h2).alias("key"), _key(d - 1, h1.bitwiseXOR(F.col("x1")), h2.bitwiseXOR(F.col("x2"))).alias("parent"), "words")


def merged(paths: DataFrame) -> DataFrame:
    """(key, depth, parent, words, conv_id, n_convs): the trie of all tasks' partial tries, merged in groups of ``FAN_IN``."""
    tasks = paths.rdd.getNumPartitions()
    table_ = paths.select(F.spark_partition_id().alias("task"), "key", "depth", "parent", "words", "conv_id", F.lit(1).cast("long").alias("n_convs"))

    def merge(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))

    while tasks > FAN_IN:  # a task adds up its rows of a node before it sends them: its partial trie
        table_ = merge(table_.withColumn("task", F.expr(f"task div {FAN_IN}").cast("int")), ["task", "key"])
        tasks = -(-tasks // FAN_IN)
    return merge(table_, ["key"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): the SHA-256 of a node's ids in order, joined by commas.

    Ids are sorted in ranges of node and id, so that no task has more than its share of a node's; a node's pieces then pass by a hash in their order."""
    spark = ends.sparkSession

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ids = rows.assign(t=rows.conv_id.astype(str)).groupby("key", sort=False)
            yield ids.agg(first=("conv_id", "first"), ids=("t", ",".join)).reset_index()

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, hashlib.sha256()
        for rows in batches:
            out = []
            for k, ids in zip(rows.key, rows.ids, strict=True):
                if k != key:
                    if key is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["key", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "ends_sha256"])

    ordered = ends.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    cut = staged(ordered.mapInPandas(pieces, "key string, first long, ids string"), "trie-ends", PIECE)
    dealt = cut.repartition("key").sortWithinPartitions("key", "first")
    return staged(dealt.mapInPandas(hashed, "key string, ends_sha256 string"), "trie-end-hashes")


def trie(turns: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, sizes, long_ = rebuilt(staged(numbered(turns), "trie-numbered"))
    root = _key(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))
    start = sizes.select("conv_id", F.lit(0).cast("long").alias("depth"), root.alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("words"))
    paths = staged(prefixes(rows).unionByName(start), "trie-paths")
    nodes = staged(merged(paths), "trie-nodes")
    # families: children of each node, and the owner of its parent
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = staged(nodes.join(children, "key", "left").na.fill(0, ["n_children"]), "trie-children")
    crowded = hot(nodes.select(F.col("key").alias("parent"), F.col("n_children").alias("n")), "parent", nodes.count())
    owners = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = spread(nodes.where("parent is not null"), owners, "parent", ["key"], crowded).select(*nodes.columns, "parent_conv_id")
    nodes = staged(below.unionByName(nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))), "trie-families")
    # what a conversation's own nodes add, from its end up
    worth = nodes.select("conv_id", "depth", "key", "parent_conv_id", ((F.col("n_convs") - 1) * F.col("words")).alias("saves"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    own = running(worth, -F.floor(F.col("depth") / STRETCH), [F.col("depth").desc()], saved_tokens=("saves", "sum"), n_leaves=("leaf", "sum"))
    own = staged(own, "trie-own")
    tops = own.where("parent_conv_id is null or parent_conv_id != conv_id").select("conv_id", F.col("depth").alias("top"), "saved_tokens", "n_leaves")
    above = spread(paths.select("conv_id", "depth", "key"), tops, "conv_id", ["depth"], long_).where("depth < top")
    added = above.select("key", "saved_tokens", "n_leaves").unionByName(own.select("key", "saved_tokens", "n_leaves"))
    rolled = added.groupBy("key").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    last = spread(paths.select("conv_id", "depth", "key"), sizes, "conv_id", ["depth"], long_).where("depth = n").select("key", "conv_id")
    ends = end_hashes(staged(last, "trie-last"))
    out = nodes.join(rolled, "key").join(ends, "key", "left")
    nobody = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda acc, b: xor(xor(acc, b) >> 1, CASE WHEN xor(acc, b) & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)), 4294967295::BIGINT)"""

#: The same with whole prefixes as keys and the subtree sums by joins.
OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {FAMILY} AND pos <= h
  UNION ALL SELECT c.conv_id, 1 AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
p AS (
  SELECT conv_id, 0 AS depth, '' AS key, NULL AS parent, 0 AS words FROM c
  UNION ALL SELECT conv_id, row_number() OVER w AS depth, string_agg(th, '') OVER w AS key, coalesce(string_agg(th, '') OVER (PARTITION BY conv_id ORDER BY own, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS parent, words
  FROM (SELECT *, md5(length(role) || ':' || role || text) AS th, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM r) WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)),
n AS (SELECT key, any_value(depth) AS depth, any_value(parent) AS parent, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY key),
k AS (SELECT n.*, o.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.parent = n.key) AS n_children FROM n LEFT JOIN n o ON o.key = n.parent),
s AS (SELECT p.key, sum((k.n_convs - 1) * k.words) AS saved_tokens, count(*) FILTER (k.n_children = 0) AS n_leaves FROM k JOIN p ON p.conv_id = k.conv_id AND p.depth <= k.depth GROUP BY p.key),
e AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM (SELECT conv_id, arg_max(key, depth) AS key FROM p GROUP BY conv_id) GROUP BY key)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM k JOIN s USING (key) LEFT JOIN e USING (key)
"""
