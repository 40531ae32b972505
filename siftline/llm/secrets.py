"""Secret scans: candidate strings judged by a random forest.

Candidates are runs of ``[A-Za-z0-9+/_-]`` of 16 characters or more, with up to two ``=`` at their end, that hold a
digit or mix cases; so a name and the value behind its ``=`` or ``:`` are two runs. What tells secrets from hashes,
ids, paths and long words: length, changes between classes of characters, shares of digits and capitals, variety,
the share covered by dictionary words, path marks in and around the candidate, and the words next to it, to which a
run right before it belongs. The forest is grown on labelled findings that are generated from a seed
(``findings``): keys and tokens of usual shapes in their usual settings, and the usual false positives. They are cut
out of texts by the code that scans (``candidates``), and the trees become one SQL expression, so texts never
leave the JVM.

Defined cases: null and empty texts have no findings; every occurrence is a finding, numbered by its
place in the text among all runs; rows without an id and repeated rows give rows like others. Only DataFrame functions
are used on texts; growing the forest works on a fixed number of feature rows on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh, table

_CHARS = "A-Za-z0-9+/_-"
CANDIDATE = rf"(?<![{_CHARS}])[{_CHARS}]{{16,}}+(?:={{1,2}}+(?![={_CHARS}]))?+"
THRESHOLD = 0.5
TREES, DEPTH, FINDINGS, SEED = 15, 5, 2400, 17

# Dictionary words looked for inside candidates, and neighbouring words.
DICTIONARY = "about access account address admin after agent alpha android apple archive array backup base beta block board book branch build button cache change check class click client cloud code color commit common config connect content control count create data date default delete demo design detail device docs domain download edit email error event example export feature file filter first float folder form format front function game general github global google group guide handle header height hello help home host html icon image import index info input install item java json label language last layout level library light line link list load local login main manage media member menu message method mobile model module name network news node note number object option order package page panel parent part path placeholder play plugin point post print product profile project public python query random read record release remote report request result return root route sample save schema script search section select server service session setting share simple site size source star start state static status store string style support system table target task team template test text theme time title token tool total type unit update upload user utils value version video view web widget width window word work world xxxx your".split()
SECRET_WORDS = "token|secret|passw(?:or)?d|pwd|api[ _-]?key|access[ _-]?key|auth|bearer|credential|private|signature|client[ _-]?key"
PLAIN_WORDS = "commit|sha\\d*|md5|checksum|hash|uuid|guid|digest|version|build|revision|etag|image|href|src|path|file|url|id|ref|serial|isbn|order"
NAMES = ("len", "runs", "digits", "capitals", "hex", "variety", "covered", "marks", "in_path", "near_secret", "near_plain", "assigned", "longest_digits")


def features(c: Column, before: Column, after: Column) -> list[Column]:
    n = F.length(c).cast("double")
    without = lambda pattern: n - F.length(F.regexp_replace(c, pattern, ""))
    low = F.lower(c)
    digit_runs = F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x))
    flag = lambda x: x.cast("double")
    return [
        F.least(n, F.lit(128.0)),
        F.size(F.regexp_extract_all(c, F.lit("[0-9]+|[a-z]+|[A-Z]+|[^0-9A-Za-z]+"), F.lit(0))) / n,
        without("[0-9]") / n,
        without("[A-Z]") / n,
        flag(c.rlike("^(?:[0-9a-f-]+|[0-9A-F-]+)$")),
        F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(40.0)),
        (n - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), ""))) / n,
        without("[/_-]") / n,
        flag(before.rlike("[/.]$") | after.rlike(r"^[./\\]\w")),
        F.when(before.rlike(rf"(?i)(?:{SECRET_WORDS})\W{{0,8}}$"), 2.0).when(before.rlike(f"(?i)(?:{SECRET_WORDS})"), 1.0).otherwise(0.0),
        F.when(before.rlike(rf"(?i)\b(?:{PLAIN_WORDS})\W{{0,8}}$"), 2.0).when(before.rlike(rf"(?i)\b(?:{PLAIN_WORDS})\b"), 1.0).otherwise(0.0),
        flag(before.rlike(r"[=:]\s*[\"'`]?$")),
        F.coalesce(F.array_max(digit_runs), F.lit(0)) / n,
    ]


def findings(spark: SparkSession, n: int = FINDINGS, seed: int = SEED) -> DataFrame:
    """``n`` labelled findings: candidate, text before, text after, label, kind. Rows follow from their number and the seed."""
    i = F.col("id")
    random = lambda salt: F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), i.cast("string")), 256)
    pick = lambda salt, *of: F.element_at(F.array(*map(F.lit, of)), F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(of))).cast("int") + 1)
    hexa, b64 = random("h"), F.regexp_replace(F.base64(F.unhex(random("b"))), "[+/=]", "x")
    words = F.concat_ws("_", pick("w1", *DICTIONARY), pick("w2", *DICTIONARY), pick("w3", *DICTIONARY))
    cut = lambda x, n: F.substring(x, 1, n)
    asked = F.concat(
        pick("p", "the ", "set ", "export ", "", "and ", "https://example.org/a?id=3&", "x; "), pick("u", "", "", "", "db_", "my_", "AWS_SECRET_"),
        pick("k", "token", "api_key", "secret", "password", "auth_token", "access key", "client_secret", "Bearer", "private key", "TOKEN", "access_token", "ACCESS_KEY"), pick("e", " = \"", "=", "=", ": ", ": '", "=\"", ":"),
    )
    plain = F.concat(pick("p", "see ", "at ", "the ", "", "in "), pick("q", "commit ", "sha256:", "md5 = ", "checksum: ", "uuid: ", "build ", "revision ", "etag=\"", "id=\"", "digest: "))
    prose = pick("r", "and the of ", "with a. ", "for their, ", "https://example.org/", "src/", "href=\"/", "page ", "- ", "")
    uuid = F.concat_ws("-", cut(hexa, 8), F.substring(hexa, 9, 4), F.substring(hexa, 13, 4), F.substring(hexa, 17, 4), F.substring(hexa, 21, 12))
    # (candidate, before, label), in turn
    kinds = [
        (cut(hexa, 40), asked, 1), (cut(hexa, 40), plain, 0), (cut(b64, 40), asked, 1), (words, asked, 0),
        (F.upper(cut(hexa, 40)), F.upper(asked), 1), (uuid, plain, 0), (cut(b64, 32), prose, 1), (F.concat(words, F.lit("_"), cut(hexa, 2)), prose, 0),
        (F.concat(F.lit("AKIA"), F.upper(cut(hexa, 16))), pick("r", "key ", "id=", "", "aws = "), 1), (F.concat(words, F.lit("/"), words), prose, 0),
        (F.concat(F.lit("ghp_"), cut(b64, 36)), pick("r", "", "with ", "token "), 1), (cut(hexa, 40), prose, 0), (cut(hexa, 32), asked, 1), (cut(hexa, 64), plain, 0),
        (F.concat(F.lit("sk_live_"), cut(b64, 24)), pick("r", "", "stripe ", "= "), 1), (F.concat(F.repeat(pick("z", "x", "0", "X", "1234"), 10), F.lit("00")), asked, 0),
        (cut(b64, 24), asked, 1), (F.concat(F.translate(cut(hexa, 24), "0123456789", "thonerinal"), F.lit("1")), prose, 0), (hexa, asked, 1), (F.translate(cut(hexa, 20), "abcdef", "123456"), prose, 0),
    ]
    kind = F.pmod(i, F.lit(len(kinds)))
    choose = lambda part: F.element_at(F.array(*[k[part] if isinstance(k[part], Column) else F.lit(k[part]) for k in kinds]), (kind + 1).cast("int"))
    return spark.range(n).select(choose(0).alias("c"), choose(1).alias("before"), pick("t", "\" and", " the", "'\n", ".", ".html", "\"!!").alias("after"), choose(2).alias("label"), kind.cast("int").alias("kind"))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[tuple]:
    """A random forest: bootstrapped rows, a few features at each split, the split of least impurity."""
    rng = np.random.default_rng(seed)

    def node(rows: np.ndarray, left: int) -> tuple:
        p = float(y[rows].mean())
        best = (p * (1 - p) * len(rows) - 1e-9, -1, 0.0)
        if left and len(rows) >= 6 and 0 < p < 1:
            for j in rng.choice(x.shape[1], 4, replace=False):
                order = np.argsort(x[rows, j], kind="stable")
                v, t = x[rows[order], j], y[rows[order]]
                at = np.flatnonzero(np.diff(v) > 1e-12)
                if not len(at):
                    continue
                ones, n = np.cumsum(t)[at], at + 1.0
                total, m = t.sum(), len(rows)
                cost = ones * (1 - ones / n) + (total - ones) * (1 - (total - ones) / (m - n))
                k = int(cost.argmin())
                if cost[k] < best[0]:
                    best = (float(cost[k]), int(j), float(v[at[k]] + v[at[k] + 1]) / 2)
        if best[1] < 0:
            return (p,)
        go = x[rows, best[1]] <= best[2]
        return best[1], best[2], node(rows[go], left - 1), node(rows[~go], left - 1)

    return [node(rng.integers(0, len(y), len(y)), depth) for _ in range(trees)]


def as_sql(tree: tuple, names: list[str]) -> str:
    if len(tree) == 1:
        return f"{tree[0]:.6f}D"
    return f"CASE WHEN {names[tree[0]]} <= {tree[1]:.9f}D THEN {as_sql(tree[2], names)} ELSE {as_sql(tree[3], names)} END"


def candidates(docs: DataFrame, at: str) -> DataFrame:
    """A row for each candidate: ``docs`` without its text, and in ``at`` its ordinal, the candidate, and the text before and after."""
    cands, pieces = fresh(docs.withColumn(at, F.lit(0)), "cands", "pieces")
    keep = [c for c in docs.columns if c != "text"]
    found = docs.withColumns({cands: F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), pieces: F.split("text", CANDIDATE, -1)}).where(F.size(cands) > 0)
    part = lambda i: F.struct(
        (i + 1).alias("ordinal"), F.get(F.col(cands), i).alias("candidate"),
        F.substring(F.concat(F.substring(F.coalesce(F.get(F.col(cands), i - 1), F.lit("")), -48, 48), F.substring(F.get(F.col(pieces), i), -48, 48)), -48, 48).alias("before"),
        F.substring(F.get(F.col(pieces), i + 1), 1, 16).alias("after"),
    )
    rows = found.select(*keep, F.explode(F.transform(F.sequence(F.lit(0), F.size(cands) - 1), part)).alias(at))
    c = F.col(at)["candidate"]
    return rows.where(c.rlike("[0-9]") | (c.rlike("[a-z]") & c.rlike("[A-Z].*[A-Z]")))


def labelled(spark: SparkSession, n: int = FINDINGS, seed: int = SEED) -> DataFrame:
    """(label, kind, at): the findings as the scan sees them; what else it cuts out of their texts, as names, is harmless."""
    rows = findings(spark, n, seed).select("c", "kind", F.concat("before", "c", "after").alias("text"), "label")
    cut = candidates(rows, "at")
    return cut.select(F.when(F.col("at.candidate") == F.col("c"), F.col("label")).otherwise(0).alias("label"), F.when(F.col("at.candidate") == F.col("c"), F.col("kind")).otherwise(-1).alias("kind"), "at")


def forest(spark: SparkSession) -> list[tuple]:
    at = F.col("at")
    rows = labelled(spark).select("label", *features(at["candidate"], at["before"], at["after"])).collect()  # FINDINGS rows, and names
    data = np.array(sorted(list(r) for r in rows), float)
    return grow(data[:, 1:], data[:, 0])


def scan(docs: DataFrame, trees: list[tuple] | None = None) -> DataFrame:
    """A row for each finding: ``docs`` without its text, and ordinal, candidate, score and ``is_secret`` (in place of columns of these names)."""
    docs = docs.drop("ordinal", "candidate", "score", "is_secret")
    trees = trees or forest(docs.sparkSession)
    at, *names = fresh(docs, "at", *(f"f_{n}" for n in NAMES))
    keep = [c for c in docs.columns if c != "text"]
    c = F.col(at)["candidate"]
    rows = candidates(docs, at).select(*keep, at, *(f.alias(n) for f, n in zip(features(c, F.col(at)["before"], F.col(at)["after"]), names, strict=True)))
    score = " + ".join(as_sql(t, names) for t in trees)
    rows = rows.withColumn("score", F.round(F.expr(f"({score}) / {len(trees)}D"), 6))
    return rows.select(*keep, F.col(at)["ordinal"].cast("long").alias("ordinal"), c.alias("candidate"), "score", (F.col("score") >= THRESHOLD).alias("is_secret"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "ordinal", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").cast("long").alias("n_chars"), "score", "is_secret")
