"""Filter interaction audit: what each of five filters removes in each of their 120 orders.

A document fails a set of filters, a mask of five bits. For each part (language) and label, tasks sum 32 signed
parities of the masks (a Walsh-Hadamard transform, whose rows are added up before the shuffle and whose size never
grows); the transform is its own inverse up to a factor of 32, so the sums give the exact number of documents of
each mask. All orders and steps are read off these cells; a filter's removals over all orders follow in closed
form, as a document that fails k filters is removed first by each of them in 120 / k orders.

Copies fail the same filters but for the last one, that a smaller id has the text: rows are counted by text and
id before they meet, so a text or an id that a third of all rows share moves as a few rows a task.

Defined cases: null text is empty, without words; a null language is the part ``''``; rows without an id are judged
but are nobody's earlier copy, copies of nothing, and have no label; repeated rows count each, and rows of one id
aren't copies of each other; a document is good or toxic if any of its labels says so; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import WORD, staged, table

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
MIN_WORDS = 200
MARKS = r"[#$%&*|]"
LABELS = 4  # 1: good, 2: toxic, 3: both
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def own_failures(text: Column) -> Column:
    """The mask of the filters that judge a text by itself: A short, B repetitive, C capitals, D marks."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words).cast("long")
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    fails = [n < MIN_WORDS, 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n, 100 * capitals > 3 * F.length(text).cast("long"), text.rlike(MARKS)]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def _sign(mask: Column, w: Column) -> Column:
    """-1 to the number of bits that both share."""
    return (1 - 2 * (F.bit_count(mask.bitwiseAND(w)) % 2)).cast("long")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, label, mask, n): how many documents fail which filters; several rows may have one mask."""
    text = F.coalesce("text", F.lit(""))
    each = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("sha"), own_failures(text).alias("mask"))
    each = staged(each.groupBy("id", "part", "sha", "mask").agg(F.count("*").alias("n")), "audit-texts")
    flag = lambda name, bit: F.max(F.when(F.col(name) == 1, bit).otherwise(0))
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("of")).agg((flag("quality", 1) + flag("toxic", 2)).alias("label"))
    # rows without an id meet no label, in different tasks
    key = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("-"), F.hex("sha")))
    labelled = each.withColumn("key", key).join(marked.select(F.col("of").cast("string").alias("key"), "label"), "key", "left")
    labelled = labelled.select("sha", "part", F.coalesce("label", F.lit(0)).alias("label"), "mask", "id", "n")
    # the rows of the least id are alone not copies; null sorts last
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    groups = labelled.groupBy("sha", "part", "label", "mask", "id").agg(F.sum("n").alias("n"))
    groups = groups.groupBy("sha", "part", "label", "mask").agg(least.alias("least"), F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    first = F.min("least.id").over(Window.partitionBy("sha"))
    groups = groups.withColumn("first", first)
    new = F.col("nameless") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = F.array(F.struct("mask", new.alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(CELLS >> 1)).alias("mask"), (F.col("n") - new).alias("n")))
    return groups.select("part", "label", F.explode(both).alias("x")).select("part", "label", "x.mask", "x.n").where("n > 0")


def parities(counted: DataFrame) -> DataFrame:
    """(part, label, sums): the 32 signed parity sums of the masks."""
    sums = [F.sum(F.col("n") * _sign(F.col("mask"), F.lit(w))).alias(f"s{w}") for w in range(CELLS)]
    return counted.groupBy("part", "label").agg(*sums).select("part", "label", F.array(*(f"s{w}" for w in range(CELLS))).alias("sums"))


def cells(sums: DataFrame) -> DataFrame:
    """(part, every, good, toxic): by mask, the number of documents, of good and of toxic ones, from the parity sums."""
    each = F.sequence(F.lit(0), F.lit(CELLS - 1))

    def cell(m: Column) -> Column:
        signed = F.transform(F.col("sums"), lambda s, w: s * _sign(m, w))
        return F.shiftright(F.aggregate(signed, F.lit(0).cast("long"), lambda a, b: a + b), len(FILTERS))

    rows = sums.select("part", "label", F.posexplode(F.transform(each, cell)).alias("mask", "n"))
    of = lambda bits: F.sum(F.when(F.col("label").isin(bits), F.col("n")).otherwise(0))
    by_mask = rows.groupBy("part", "mask").agg(F.sum("n").alias("every"), of([1, 3]).alias("good"), of([2, 3]).alias("toxic"))
    ordered = by_mask.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "every", "good", "toxic"))).alias("c"))  # 32 rows a part
    return ordered.select("part", *(F.col(f"c.{x}").alias(x) for x in ("every", "good", "toxic")))


def _steps() -> Column:
    """All orders and steps: (filter_order, step, bit, before), ``before`` being the filters applied so far."""
    rows = [
        {"filter_order": "".join(order), "step": i + 1, "bit": 1 << FILTERS.index(order[i]), "before": sum(1 << FILTERS.index(f) for f in order[:i])}
        for order in permutations(FILTERS) for i in range(len(order))
    ]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order string, step int, bit int, before int>>")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step, with the counts that COUNTS names."""
    rows = cells(parities(failures(docs, labels))).select("*", F.explode(_steps()).alias("s")).select("part", "every", "good", "toxic", "s.*")
    bit, before = F.col("bit"), F.col("before")

    def total(counts: str, take) -> Column:
        of = F.transform(F.col(counts), lambda n, m: F.when(take(m), n).otherwise(0))
        return F.aggregate(of, F.lit(0).cast("long"), lambda a, b: a + b)

    fails, done = (lambda m: m.bitwiseAND(bit) != 0), (lambda m: m.bitwiseAND(before) != 0)
    here = lambda m: fails(m) & ~done(m)
    # the orders in which a filter comes first of all those that a document fails
    share = F.transform(F.col("every"), lambda n, m: F.when(fails(m), n * F.expr("120L") / F.greatest(F.bit_count(m), F.lit(1))).otherwise(0).cast("long"))
    return rows.select(
        "part", "filter_order", "step",
        total("every", lambda m: ~fails(m) & ~done(m)).alias("kept"), total("every", here).alias("removed"), total("every", lambda m: fails(m) & done(m)).alias("redundant"),
        F.get(F.col("every"), bit).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda a, b: a + b).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


#: The same without a transform: each order is walked over the documents' own failures.
OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN len(w) < {MIN_WORDS} WHEN 'B' THEN 100 * len(list_distinct(w)) < 50 * len(w)
      WHEN 'C' THEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) WHEN 'D' THEN regexp_matches(text, '{MARKS}') ELSE coalesce(doc_id > least_id, false) END) AS fails
  FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS least_id FROM d) LEFT JOIN l USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS own, string_split(filter_order[:step - 1], '') AS before FROM o, range(1, 6) AS r(step)),
j AS (SELECT part, filter_order, step, own, list_contains(fails, own) AS failing, list_has_any(fails, before) AS gone, fails, n, good, toxic FROM s, m),
t AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (failing AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (failing AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = [own]), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (failing AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (failing AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM j GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM t
"""
