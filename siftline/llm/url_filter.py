"""URL filters: host and path rules, and a character language-model ratio for what no rule covers.

URLs under an allow rule are the accepted ones and those under a block rule the rejected ones. Their
characters (32 classes) are counted over four fifths of them, after contexts of up to ``ORDER`` characters; a
context is kept where at least one in ``RARE`` of all characters follows it (one in the cube root of their number,
where that is more), so contexts are as long as the counts allow and of each length only so many. Kept contexts are smoothed by Witten-Bell interpolation, the longer over
the next shorter, and are the states of an automaton that reads a URL. A URL's score is the mean over its
characters of the log-likelihood under the accepted model less that under the rejected one. The score from which
URLs pass is the one that best separates the fifth that wasn't counted (the largest sum of both rates of right
verdicts, over scores in steps of 0.05; the lowest such step, and there the middle of the gap below it).

The automaton is two arrays that grow with the cube root of the input, and scores are a fold over a URL's characters, without a
shuffle.

Defined cases: a null url or one without ``://`` has an empty host and path, which no rule fits and whose
score is 0 (as of any url without characters); without ruled URLs of both kinds the threshold is 0 (without them
in the fifth, all ruled URLs set it), and every unruled URL with a score of at least the threshold passes; rows
are judged each by itself, repeated or without a page_id; columns of ``pages`` that have the name of a result are
replaced by it. Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import LOWER, UPPER, fresh, table

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
CLASSES = 32
ORDER = 5
RARE = 1000
STEP = 0.05
# The classes of characters: letters, digits and four marks; the last is anything else. A URL begins after ``_START``s.
_KNOWN = LOWER + "0/.-_"
_OTHER, _START = "~", "^"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``pages`` with host, path, and the longest rule that fits and its verdict."""
    out = pages.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # a longer one overrides
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return out.withColumns({"rule": rule, "ruled": verdict})


def plain() -> Column:
    """Host and path in their classes, a character each."""
    out = F.translate(F.translate(F.concat("host", "path"), UPPER, LOWER), "123456789", "000000000")
    return F.regexp_replace(out, r"(?s)[^a-z0/._-]", _OTHER)


def counts(urls: DataFrame) -> list[tuple[str, int, int]]:
    """How often each gram (a kept context and the character after it) stands in accepted and in rejected URLs; bounded by RARE."""
    some = urls.where("ruled is not null and chars != ''").select("ruled", F.concat(F.lit(_START * ORDER), "chars").alias("x"))
    total = some.agg(F.sum(F.length("x") - ORDER)).first()[0] or 0
    each = some.select("ruled", F.explode(F.transform(F.sequence(F.lit(1), F.length("x") - ORDER), lambda i: F.substring("x", i, F.lit(ORDER + 1)))).alias("gram"))
    whole = each.groupBy("gram").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    every = whole.select(F.explode(F.array(*(F.expr(f"right(gram, {k + 1})") for k in range(ORDER + 1)))).alias("gram"), "good", "bad")
    by = every.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    follow = F.sum(F.col("good") + F.col("bad")).over(Window.partitionBy(F.expr("left(gram, length(gram) - 1)")))
    return [(r.gram, r.good, r.bad) for r in by.withColumn("n", follow).where(F.col("n") * max(RARE, round(total ** (1 / 3))) >= total).select("gram", "good", "bad").collect()]


def automaton(rows: list[tuple[str, int, int]]) -> tuple[list[int], list[float]]:
    """For each state and class, the state that follows and the log ratio; the first state is that of a URL's beginning."""
    symbol = {c: i for i, c in enumerate(_KNOWN + _OTHER)}
    seen: dict[str, list[list[int]]] = {"": [[0] * CLASSES, [0] * CLASSES]}
    for gram, good, bad in rows:
        own = seen.setdefault(gram[:-1], [[0] * CLASSES, [0] * CLASSES])
        own[0][symbol[gram[-1]]], own[1][symbol[gram[-1]]] = good, bad
    models: dict[str, list[list[float]]] = {}
    for context in sorted(seen, key=len):
        shorter = models[context[1:]] if context else [[1 / CLASSES] * CLASSES] * 2
        models[context] = [[(n + t * p) / (total + t) for n, p in zip(own, base, strict=True)] for own, base in zip(seen[context], shorter, strict=True) for t, total in [(max(1, sum(map(bool, own))), sum(own))]]

    def state(text: str) -> str:
        text = text[-ORDER:]
        while text not in models:
            text = text[1:]
        return text

    first = state(_START * ORDER)
    order = [first, *(c for c in models if c != first)]
    number = {c: i for i, c in enumerate(order)}
    after = [number[state(c + x)] for c in order for x in symbol]
    return after, [round(math.log(g) - math.log(b), 6) for c in order for g, b in zip(*models[c], strict=True)]


def with_score(urls: DataFrame, after: list[int], ratio: list[float]) -> DataFrame:
    # constant arrays: parsed from text when the plan is made
    states, numbers = F.from_json(F.lit(str(after)), "array<int>"), F.from_json(F.lit(str(ratio)), "array<double>")
    place = F.transform(F.filter(F.split("chars", ""), lambda c: c != ""), lambda c: F.position(c, F.lit(_KNOWN + _OTHER)) - 1)
    at = lambda acc, c: acc["state"] * CLASSES + c
    begin = F.struct(F.lit(0).alias("state"), F.lit(0.0).alias("sum"))
    total = F.aggregate(place, begin, lambda acc, c: F.struct(F.get(states, at(acc, c)).alias("state"), (acc["sum"] + F.get(numbers, at(acc, c))).alias("sum")), lambda acc: acc["sum"])
    return urls.withColumn("score", F.when(F.col("chars") != "", F.round(total / F.length("chars"), 6)).otherwise(0.0))


def threshold(scored: DataFrame) -> float | None:
    """The step of scores that separates accepted from rejected URLs best; None without both kinds."""
    steps = scored.where("ruled is not null").groupBy(F.floor(F.col("score") / STEP).alias("k")).agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    rows = sorted((r.k, r.good, r.bad) for r in steps.collect())  # scores are bounded, and so are steps
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return None
    best, passed_bad, failed_good, under = (-1.0, 0.0), bad, 0, rows[0][0]
    for k, g, b in rows:  # passing from step k on
        right = (good - failed_good) / good + (bad - passed_bad) / bad
        if right > best[0] + 1e-12:
            best = (right, (under + k) / 2 * STEP)
        under = k + 1
        failed_good, passed_bad = failed_good + g, passed_bad - b
    return best[1]


def judged(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``pages`` with host, path, rule, score and verdict."""
    pages = pages.drop("host", "path", "rule", "score", "verdict")
    theirs = dict(zip(("chars", "ruled"), fresh(pages, "their_chars", "their_ruled"), strict=True))
    urls = ruled(pages.select("url"), rules).withColumn("chars", plain()).withColumn("held", F.pmod(F.xxhash64("host", "path"), F.lit(5)) == 0)
    model = automaton(counts(urls.where("not held").select("ruled", "chars")))
    scored = with_score(urls, *model)
    least = threshold(scored.where("held"))
    if least is None:
        least = threshold(scored)
    out = with_score(ruled(pages.withColumnsRenamed(theirs), rules).withColumn("chars", plain()), *model)
    verdict = F.coalesce("ruled", F.when(F.col("score") >= (least or 0.0), "allow").otherwise("block"))
    out = out.withColumn("verdict", verdict)
    given = [F.col(theirs.get(c, c)).alias(c) for c in pages.columns]
    return out.select(*given, "host", "path", "rule", "score", "verdict")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
