"""BM25 over two weighted columns, for many queries in one job.

The dictionary tells what terms weigh before any block is read. The peaks of blocks bound the score of every chunk
in a range; the ranges of the highest bounds are scored first, and then only those whose bound reaches the
score of the last one of the best chunks so far. Numbers of the best chunks are all that goes on; their texts are
fetched by number.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.config import DEFAULT, Settings
from siftline.functions.tokenize import query_phrases
from siftline.sources.files import scratch

from .index import RANGE, Index, bit, local

MANY = 20_000  # rows, ranges or chunks up to which the driver names what is to be read; beyond, a join does
PRUNED = 10_000  # blocks of a query from which bounds are worth their jobs
DIGITS = 9  # scores that are equal to so many are ties


@dataclass
class Asked:
    """The queries' phrases: ``numbers`` of phrases, and ``use``, a row (q, pid, times, wanted) for each phrase of a query."""

    numbers: dict[tuple[str, ...], int]
    use: list[tuple[int, int, int, int]]

    @classmethod
    def of(cls, queries: dict[int, str]) -> Asked:
        asked = {q: query_phrases(text) for q, text in queries.items()}
        numbers = {p: i for i, p in enumerate(dict.fromkeys(p for ps in asked.values() for p in ps if p))}
        return cls(numbers, [(q, numbers[p], n, len({*ps})) for q, ps in asked.items() for p, n in Counter(ps).items() if p])

    def terms(self) -> list[str]:
        return sorted({t for p in self.numbers for t in p})


def _gain(tf: Column, dl: Column, index: Index, settings: Settings) -> Column:
    """What a phrase of weight one adds to a score; grows with ``tf`` and falls with ``dl``."""
    return tf * (settings.k1 + 1) / (tf + settings.k1 * (1 - settings.b + settings.b * dl / index.avg_length))


def _tf(p: Column, b: Column, settings: Settings) -> Column:
    return (settings.path_weight * p + settings.body_weight * b).cast("double")


def phrase_rows(found: DataFrame, phrases: dict[tuple[str, ...], int], settings: Settings = DEFAULT) -> DataFrame:
    """(pid, segment, range, docs): where neighbouring places make a phrase. A range's blocks of all of its terms meet in one row, and places are intersected in it."""
    rows = [(pid, i, t, len(p)) for p, pid in phrases.items() for i, t in enumerate(p)]
    wanted = F.broadcast(local(found.sparkSession, rows, "pid int, i int, term string, n_terms int"))  # the queries' own terms
    both = found.select("segment", "range", "term", "docs", "places").join(wanted, "term")
    met = both.groupBy("pid", "n_terms", "segment", "range").agg(F.sort_array(F.collect_list(F.struct("i", "docs", "places"))).alias("x")).where("size(x) = n_terms")
    first = F.get("x", 0)

    def starts(d: Column, column: str) -> Column:
        """Where the phrase begins in the ``d``-th chunk of the first term's."""
        none = F.array().cast("array<int>")

        def narrow(acc: Column, y: Column) -> Column:
            k = F.array_position(F.transform(y.docs, lambda z: z.at), F.get(first.docs, d).at).cast("int")
            return F.array_intersect(acc, F.transform(F.coalesce(F.get(y.places, k - 1)[column], none), lambda p: p - y.i))

        return F.size(F.aggregate(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), F.get(first.places, d)[column], narrow))

    def doc(d: Column) -> Column:
        return F.struct(F.get(first.docs, d).at.alias("at"), F.get(first.docs, d).dl.alias("dl"), _tf(starts(d, "p"), starts(d, "b"), settings).alias("tf"))

    docs = F.filter(F.transform(F.sequence(F.lit(0), F.size(first.docs) - 1), doc), lambda x: x.tf > 0)
    return met.select("pid", "segment", "range", docs.alias("docs")).where("size(docs) > 0")


def _living(rows: DataFrame, masks: DataFrame | None) -> DataFrame:
    """Rows of ranges, without the chunks that are gone."""
    if masks is None:
        return rows
    held = rows.join(masks, ["segment", "range"], "left")
    kept = F.filter("docs", lambda d: F.col("mask").isNull() | (F.col("mask").bitwiseAND(bit(d.at)) == 0))
    return held.withColumn("docs", kept).drop("mask")


def _named(index: Index, ranges: list, columns: str) -> DataFrame:
    return F.broadcast(local(index.spark, ranges, columns))


class Search:
    """The phrases of some queries in an index, with their weights."""

    def __init__(self, index: Index, queries: dict[int, str], mode: str = "OR", settings: Settings = DEFAULT):
        if mode not in ("OR", "AND"):
            raise ValueError(f"mode must be OR or AND, not {mode!r}")
        self.index, self.mode, self.settings = index, mode, settings
        self.asked = asked = Asked.of(queries)
        self.entries, self.found = index.look_up(asked.terms(), settings) if asked.use and index.n_chunks else ([], None)
        self.several = {p: i for p, i in asked.numbers.items() if len(p) > 1}
        self.masks = index.masks()
        df = Counter()
        for r in self.entries:
            df[r.term] += r.df
        self.df = {i: df[p[0]] for p, i in asked.numbers.items() if len(p) == 1}
        self.phrases = None
        if self.several and self.found is not None:
            spark, path = index.spark, scratch(index.spark, "phrases")
            _living(phrase_rows(self.found, self.several, settings), self.masks).where("size(docs) > 0").write.parquet(path)
            self.phrases = spark.read.schema("pid int, segment string, range long, docs array<struct<at:int,dl:int,tf:double>>").parquet(path)
            self.df |= dict.fromkeys(self.several.values(), 0) | {r.pid: r.n for r in self.phrases.groupBy("pid").agg(F.sum(F.size("docs")).alias("n")).collect()}
        # a query in AND mode without one of its phrases has no hits
        whole = {q for q, *_ in asked.use} - ({q for q, pid, *_ in asked.use if not self.df.get(pid)} if mode == "AND" else set())
        self.use = [(*u, self.df[u[1]]) for u in asked.use if u[0] in whole and self.df.get(u[1])]

    def weights(self) -> DataFrame:
        """(q, pid, wanted, weight): a row for each phrase of a query."""
        df, n, s = F.col("df"), self.index.n_chunks, self.settings
        idf = F.log((n - df + 0.5) / (df + 0.5))
        rows = local(self.index.spark, self.use, "q int, pid int, times int, wanted int, df long")
        return F.broadcast(rows.select("q", "pid", "wanted", (F.when(idf <= 0, F.lit(s.min_idf)).otherwise(idf) * F.col("times")).alias("weight")))  # the queries' own phrases

    def _numbered(self, columns: list[str]) -> DataFrame:
        """Blocks of the single terms with their phrase's number."""
        ids = [(p[0], i) for p, i in self.asked.numbers.items() if len(p) == 1]
        return self.found.select("segment", "range", "term", *columns).join(_named(self.index, ids, "term string, pid int"), "term").drop("term")

    def bounds(self) -> DataFrame:
        """(q, segment, range, bound): what no chunk's score exceeds."""
        best = F.array_max(F.transform("peaks", lambda x: _gain(x.tf, x.dl, self.index, self.settings)))
        rows = self._numbered(["peaks"]).select("segment", "range", "pid", best.alias("gain")).join(self.weights(), "pid")
        out = rows.groupBy("q", "segment", "range").agg(F.sum(F.col("gain") * F.col("weight")).alias("bound"), F.count("*").alias("k"), F.first("wanted").alias("wanted"))
        return (out.where("k = wanted") if self.mode == "AND" else out).select("q", "segment", "range", "bound")

    def scored(self, ranges: list | DataFrame | None = None) -> DataFrame:
        """(q, segment, no, score) of all chunks that match, or of those in ``ranges`` (q, segment, range); the least score is the best."""
        s, parts = self.settings, []
        keep = None
        if self.found is not None and len(self.several) < len(self.asked.numbers):
            rows = self._numbered(["docs"]) if not isinstance(ranges, list) else self._numbered(["docs"]).where(self._among(ranges))
            parts.append(rows.withColumn("docs", F.transform("docs", lambda d: F.struct(d.at.alias("at"), d.dl.alias("dl"), _tf(d.p, d.b, s).alias("tf")))).select("pid", "segment", "range", "docs"))
        rows = parts[0] if parts else None
        if self.phrases is not None:
            rows = self.phrases if rows is None else rows.unionByName(self.phrases)
        if rows is None or not self.use:
            return local(self.index.spark, [], "q int, segment string, no long, score double")
        each = rows.join(self.weights(), "pid")
        if ranges is not None:
            keep = _named(self.index, [tuple(r[:3]) for r in ranges], "q int, segment string, range long") if isinstance(ranges, list) else ranges.select("q", "segment", "range")
            each = each.join(keep, ["q", "segment", "range"])
        # blocks of a range meet, then its chunks are freed of those that are gone
        gains = F.transform("docs", lambda d: F.struct(d.at.alias("at"), (_gain(d.tf, d.dl, self.index, s) * F.col("weight")).alias("part")))
        flat = each.select("q", "segment", "range", "wanted", F.explode(gains).alias("d"))
        sums = flat.groupBy("q", "segment", "range", F.col("d.at").alias("at")).agg((-F.sum("d.part")).alias("score"), F.count("*").alias("k"), F.first("wanted").alias("wanted"))
        if self.mode == "AND":
            sums = sums.where("k = wanted")
        if self.masks is not None:
            sums = sums.join(self.masks, ["segment", "range"], "left").where(F.col("mask").isNull() | (F.col("mask").bitwiseAND(bit(F.col("at"))) == 0))
        return sums.select("q", "segment", (F.col("range") * RANGE + F.col("at")).alias("no"), "score")

    def _among(self, ranges: list) -> Column:
        """The ranges as a condition that reaches the scan."""
        out = None
        for segment in {r[1] for r in ranges}:
            own = (F.col("segment") == segment) & F.col("range").isin(sorted({r[2] for r in ranges if r[1] == segment}))
            out = own if out is None else out | own
        return F.lit(False) if out is None else out

    def candidates(self, k: int, always: bool = False) -> list | DataFrame | None:
        """The ranges (q, segment, range, bound) that can hold one of the best ``k`` chunks, or None if all are to be read."""
        blocks = Counter()
        for r in self.entries:
            blocks[r.term] += r.blocks
        term = {i: p[0] for p, i in self.asked.numbers.items()}
        per_query = Counter()
        for q, pid, *_ in self.use:
            per_query[q] += blocks[term[pid]]
        same = all(about.get("weights") == [self.settings.path_weight, self.settings.body_weight] for about in (self.index.at.segments if self.index.at else {}).values())
        if not self.use or self.several or not same or len(per_query) * k > MANY or not (always or max(per_query.values()) > PRUNED):
            return None
        bounds = self.bounds()
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "segment", "range"))
        first = [tuple(r) for r in bounds.withColumn("place", place).where(F.col("place") <= k).drop("place").collect()]
        nth = F.row_number().over(Window.partitionBy("q").orderBy("score"))
        reached = {r.q: r.score for r in self.scored(first).withColumn("nth", nth).where(F.col("nth") == k).collect()}
        least = _named(self.index, [(q, -reached[q] if q in reached else float("-inf")) for q in per_query], "q int, least double")
        may = bounds.join(least, "q").where(F.col("bound") >= F.col("least") - 2 * 10.0**-DIGITS).drop("least")
        some = [tuple(r) for r in may.limit(MANY + 1).collect()]
        return some if len(some) <= MANY else may


def scores(index: Index, queries: dict[int, str], mode: str = "OR", settings: Settings = DEFAULT) -> DataFrame:
    """(q, segment, no, score) of all chunks that match; the least score is the best."""
    return Search(index, queries, mode, settings).scored()


def top(index: Index, scored: DataFrame, k: int) -> DataFrame:
    """The best ``k`` chunks of each query, with what to show; equal scores go by chunk."""
    score = F.round("score", DIGITS)
    tied = scored.withColumn("r", F.rank().over(Window.partitionBy("q").orderBy(score))).where(F.col("r") <= k).drop("r")
    some = tied.orderBy("q", score).limit(MANY + 1).collect()
    schema = "q int, segment string, no long, score double"
    if len(some) <= MANY:
        numbers: dict[str, list[int]] = {}
        for r in some:
            numbers.setdefault(r.segment, []).append(r.no)
        shown = index.fetch({s: sorted({*x}) for s, x in numbers.items()}).join(_named(index, [tuple(r) for r in some], schema), ["segment", "no"])
    else:
        shown = index.chunks().join(tied, ["segment", "no"])
    order = Window.partitionBy("q").orderBy(F.round("score", DIGITS), "chunk_id", "segment", "no")
    return shown.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "rank", "score", "chunk_id", "filepath", "start_line", "end_line", "raw_snippet")


def best(index: Index, queries: dict[int, str], k: int, mode: str = "OR", settings: Settings = DEFAULT) -> DataFrame:
    """The best ``k`` chunks of each query; blocks that can't hold one aren't read."""
    search_ = Search(index, queries, mode, settings)
    return top(index, search_.scored(search_.candidates(k)), k)


def blocks_read(index: Index, queries: dict[int, str], k: int, settings: Settings = DEFAULT) -> tuple[int, int]:
    """How many of the queries' blocks a search for ``k`` chunks reads, and how many there are."""
    search_ = Search(index, queries, settings=settings)
    ranges = search_.candidates(k, always=True)
    every = sum(r.blocks for r in search_.entries)
    if ranges is None:
        return every, every
    if isinstance(ranges, list):
        return search_.found.where(search_._among(ranges)).count(), every
    return search_.found.join(ranges.select("segment", "range").distinct(), ["segment", "range"], "left_semi").count(), every


def search(index: Index, queries: dict[int, str], top_k: int = 5, mode: str = "OR", diversify: bool = True, settings: Settings = DEFAULT) -> DataFrame:
    """(q, rank, filepath, start_line, end_line, raw_snippet, score)."""
    from .post import thinned

    pool = best(index, queries, settings.pool(top_k) if diversify else top_k, mode, settings)
    return thinned(pool, top_k, settings) if diversify else pool.drop("chunk_id")
