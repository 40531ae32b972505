"""The registered queries by name, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.config import EXTENSIONS, HINT, ZERO_MATCH, Settings
from siftline.functions import text as tx
from siftline.functions import tokenize as tk
from siftline.operators import post, rank
from siftline.operators.chunk import chunks
from siftline.operators.index import Index, with_ids, with_terms
from siftline.operators.render import render
from siftline.serving.service import find
from siftline.sources.files import name_status, read_files, scratch, write
from siftline.streaming.follow import CHANGES, follow
from siftline.streaming.sync import Store, changes, resynced

from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SMALL = Settings(chunk_lines=10, overlap=3, near_lines=7)


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# SQL of the tokenizer, chunker and scorer ------------------------------------------------------------------

_TOK = """flatten(list_transform(regexp_extract_all({x}, '[A-Za-z_][A-Za-z0-9_]*|[\\x{{3040}}-\\x{{30FF}}\\x{{3400}}-\\x{{9FFF}}]+'), lambda w: CASE
  WHEN regexp_matches(w, '^[A-Za-z_]') THEN list_concat([lower(w)], CASE WHEN contains(w, '_') OR regexp_matches(w, '[a-z][A-Z]')
    THEN list_transform(regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda p: lower(p)) ELSE []::VARCHAR[] END)
  WHEN length(w) <= 1 THEN [w] ELSE list_transform(range(1, length(w)), lambda i: substr(w, i::INT, 2)) END))"""
_FTS = "list_filter(flatten(list_transform({x}, lambda t: string_split(t, '_'))), lambda t: t <> '')"
_PATH = "regexp_extract_all(lower({x}), '[a-z0-9]+')"
_LINES = "SELECT filepath, CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls FROM corpus"


def _chunk_sql(size: int, overlap: int, snap: bool) -> str:
    end = f"least(s + {size}, n)"
    if snap:
        end = f"CASE WHEN {end} < n THEN coalesce(list_min(list_filter(range({end}, least({end} + 10, n)), lambda i: trim(ls[i + 1], ' ' || chr(9)) = '')) + 1, {end}) ELSE {end} END"
    return f"""lines AS ({_LINES}), starts AS (
      SELECT filepath, ls, len(ls) AS n, unnest(range(0, len(ls), {size - overlap})) AS s FROM lines),
    ends AS (SELECT *, {end} AS e FROM starts),
    chunks AS (
      SELECT filepath, (s + 1)::INT AS start_line, e::INT AS end_line, array_to_string(ls[s + 1 : e], chr(10)) AS raw_snippet
      FROM ends WHERE s = 0 OR s IN (SELECT x.s + {size - overlap} FROM ends x WHERE x.filepath = ends.filepath AND x.e < x.n))"""


def _whole(corpus: str) -> str:
    """A corpus as one chunk a file."""
    return f"corpus AS ({fx.SQL[corpus]}), chunks AS (SELECT filepath, 1 AS start_line, 1 AS end_line, text AS raw_snippet FROM corpus)"


def _terms_sql() -> str:
    body = f"list_concat({_TOK.format(x='filepath')}, {_TOK.format(x='raw_snippet')})"
    return f"terms AS (SELECT filepath, start_line, end_line, raw_snippet, {_PATH.format(x='filepath')} AS p, {_FTS.format(x=body)} AS b FROM chunks)"


def _score_sql(queries: dict[int, str], mode: str = "OR") -> str:
    """``scored``: (q, filepath, start_line, end_line, raw_snippet, score). Queries are cut into phrases in SQL too."""
    texts = ", ".join(f"({q}, '{t}')" for q, t in queries.items())
    count = "CASE WHEN len(ph) = 1 THEN len(list_filter({x}, lambda t: t = ph[1])) ELSE len(list_filter(range(1, len({x}) - len(ph) + 2), lambda i: {x}[i : i + len(ph) - 1] = ph)) END"
    having = "HAVING count(DISTINCT c.ph) = (SELECT count(DISTINCT w.ph) FROM asked w WHERE w.q = c.q)" if mode == "AND" else ""
    return f"""{_terms_sql()}, stats AS (SELECT count(*) AS n, avg(len(p) + len(b)) AS avgdl FROM terms),
    asked AS (SELECT q, i, list_filter(string_split(t, '_'), lambda x: x <> '') AS ph FROM (
      SELECT q, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM (SELECT q, {_TOK.format(x='text')} AS ts FROM (VALUES {texts}) AS v(q, text)))),
    phrases AS (SELECT DISTINCT ph FROM asked),
    tf AS (SELECT * FROM (SELECT filepath, start_line, ph, len(p) + len(b) AS dl, 3.0::DOUBLE * {count.format(x='p')} + {count.format(x='b')} AS tf
      FROM terms, phrases WHERE list_has_any(list_concat(p, b), ph)) WHERE tf > 0),
    df AS (SELECT ph, count(*) AS df FROM tf GROUP BY ph),
    idf AS (SELECT ph, CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END AS idf FROM df, stats),
    c AS (SELECT asked.q, tf.ph, filepath, start_line, idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS part
      FROM tf JOIN asked ON asked.ph = tf.ph JOIN idf ON idf.ph = tf.ph, stats),
    sums AS (SELECT q, filepath, start_line, -sum(part) AS score FROM c GROUP BY q, filepath, start_line {having}),
    scored AS (SELECT sums.*, terms.end_line, terms.raw_snippet FROM sums JOIN terms USING (filepath, start_line)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9), filepath || '#' || lpad(start_line::VARCHAR, 9, '0')) AS rank FROM scored)"""


def _index(spark: SparkSession, sf_dir: str, corpus: str, settings: Settings | None = None) -> Index:
    text = getattr(fx, corpus)(spark, sf_dir)
    if settings:
        return Index.of(chunks(text, settings))
    return Index.of(text.select("filepath", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("text").alias("raw_snippet")))


def _searched(name: str, corpus: str, texts: dict[int, str], k: int, mode: str = "OR") -> None:
    """Register a search over whole files of a corpus."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = rank.search(_index(spark, sf_dir, corpus), texts, k, mode, diversify=False)
        return hits.select("q", "rank", "filepath", F.round("score", 6).alias("score"))

    run.__name__ = name
    query(f"WITH {_whole(corpus)}, {_score_sql(texts, mode)} SELECT q, rank::INT AS rank, filepath, round(score, 6) AS score FROM ranked WHERE rank <= {k}")(run)


# Predicates and tokens -------------------------------------------------------------------------------------

_ENDS = ", ".join(f"'{e}'" for e in EXTENSIONS)


@query(f"""WITH p AS (SELECT doc_id, ['a/b.py', 'x/.md', 'y/K.BLADE.PHP', 'z/n.bin', 'q/f.tsx', 'r.txt', 'dir.py/none'][(doc_id % 7 + 1)::INT] AS filepath FROM documents),
n AS (SELECT *, lower(string_split(filepath, '/')[-1]) AS name FROM p)
SELECT doc_id, filepath, len(list_filter([{_ENDS}], lambda e: ends_with(name, e) AND length(name) > length(e))) > 0 AS indexed FROM n""")
def q01_extension_predicate(spark, sf_dir):
    names = F.array(*map(F.lit, ["a/b.py", "x/.md", "y/K.BLADE.PHP", "z/n.bin", "q/f.tsx", "r.txt", "dir.py/none"]))
    d = fx.read(spark, sf_dir, "documents").select("doc_id", F.element_at(names, (F.col("doc_id") % 7 + 1).cast("int")).alias("filepath"))
    return d.select("doc_id", "filepath", tx.matches_extension(F.col("filepath")).alias("indexed"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}]+'))::INT AS n_words FROM documents")
def q02_word_scan(spark, sf_dir):
    return fx.read(spark, sf_dir, "documents").select("doc_id", F.size(tk.word_scan(F.col("text"))).alias("n_words"))


def _token_query(name: str, corpus: str) -> None:
    def run(spark, sf_dir):
        return getattr(fx, corpus)(spark, sf_dir).select("filepath", F.array_join(tk.tokens(F.col("text")), " ").alias("tokens"))

    run.__name__ = name
    query(f"WITH corpus AS ({fx.SQL[corpus]}) SELECT filepath, array_to_string({_TOK.format(x='text')}, ' ') AS tokens FROM corpus")(run)


_token_query("q03_identifier_split", "idents")
_token_query("q04_cjk_bigrams", "cjk")


@query(f"WITH corpus AS ({fx.SQL['docs']}) SELECT filepath, array_to_string({_PATH.format(x='filepath')}, ' ') AS terms FROM corpus")
def q05_path_terms(spark, sf_dir):
    return fx.docs(spark, sf_dir).select("filepath", F.array_join(tk.path_terms(F.col("filepath")), " ").alias("terms"))


#: The same names with marks as parts of letters and by themselves.
_MARKED = "CASE WHEN doc_id % 2 = 0 THEN 'École/Übër_ñ' ELSE 'E\u0301cole/U\u0308be\u0308r_n\u0303' END || '/' || source || '_' || doc_id || '.md'"


@query(f"SELECT doc_id, array_to_string(regexp_extract_all(lower(strip_accents({_MARKED})), '[a-z0-9]+'), ' ') AS terms FROM documents")
def q37_path_marks(spark, sf_dir):
    return fx.read(spark, sf_dir, "documents").select("doc_id", F.array_join(tk.path_terms(F.expr(_MARKED)), " ").alias("terms"))


@query(f"WITH corpus AS ({fx.SQL['files']}), lines AS ({_LINES}) SELECT filepath, len(ls)::INT AS n_lines FROM lines")
def q06_line_counts(spark, sf_dir):
    return fx.files(spark, sf_dir).select("filepath", F.size(tx.lines(F.col("text"))).alias("n_lines"))


# Chunks ----------------------------------------------------------------------------------------------------


def _chunk_query(name: str, size: int, overlap: int, snap: bool, text: bool = False) -> None:
    def run(spark, sf_dir):
        out = chunks(fx.files(spark, sf_dir), Settings(chunk_lines=size, overlap=overlap), snap)
        last = [F.sha2("raw_snippet", 256).alias("sha256")] if text else []
        return out.select("filepath", "start_line", "end_line", *last)

    run.__name__ = name
    query(f"WITH corpus AS ({fx.SQL['files']}), {_chunk_sql(size, overlap, snap)} SELECT filepath, start_line, end_line{', sha256(raw_snippet) AS sha256' if text else ''} FROM chunks")(run)


_chunk_query("q07_chunk_bounds", 80, 20, False)
_chunk_query("q08_chunk_bounds_snapped", 80, 20, True)
_chunk_query("q09_chunk_bounds_small", 10, 3, True)
_chunk_query("q10_chunk_text", 80, 20, True, text=True)

# Statistics ------------------------------------------------------------------------------------------------


def _doc_terms(spark, sf_dir):
    d = fx.docs(spark, sf_dir).select("filepath", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("text").alias("raw_snippet"))
    return with_terms(with_ids(d))


@query(f"WITH {_whole('docs')}, {_terms_sql()}, t AS (SELECT DISTINCT filepath, unnest(list_concat(p, b)) AS term FROM terms) SELECT term, count(*) AS df FROM t GROUP BY term")
def q11_term_df(spark, sf_dir):
    return _index(spark, sf_dir, "docs").terms().select("term", "df")


@query(f"WITH {_whole('docs')}, {_terms_sql()} SELECT count(*) AS n_chunks, round(avg(len(p) + len(b)), 6) AS avg_length FROM terms")
def q12_corpus_stats(spark, sf_dir):
    return _doc_terms(spark, sf_dir).agg(F.count("*").alias("n_chunks"), F.round(F.avg(F.size("path_terms") + F.size("body_terms")), 6).alias("avg_length"))


@query(f"WITH {_whole('docs')}, {_terms_sql()} SELECT filepath, len(p)::INT AS path_terms, len(b)::INT AS body_terms FROM terms")
def q13_chunk_lengths(spark, sf_dir):
    return _doc_terms(spark, sf_dir).select("filepath", F.size("path_terms").alias("path_terms"), F.size("body_terms").alias("body_terms"))


# Searches --------------------------------------------------------------------------------------------------

_searched("q14_bm25_single_term", "docs", {0: "token"}, 20)
_searched("q15_bm25_or", "docs", {0: "ention thand thand worthless"}, 20)
_searched("q16_bm25_and", "docs", {0: "the token of"}, 20, "AND")
_searched("q17_bm25_common_terms", "docs", {0: "the of"}, 20)
_searched("q18_bm25_phrase", "idents", {0: "blue_steel red_copper", 1: "getUserName almond"}, 20)
_searched("q19_bm25_path_boost", "docs", {0: "src7 token"}, 20)
_searched("q31_bm25_web", "web", {0: "example casino net"}, 20)
_searched("q32_bm25_chat", "chat", {0: "thing the chat"}, 20)
_searched("q33_bm25_batch", "docs", {i: t for i, t in enumerate(["token", "the and", "src3 en", "que las", "der und die", "ention", "idiot loser", "MIT license", "nothingmatchesthis", "de la"])}, 10)

_MULTI = {0: "token the", 1: "thand ention", 2: "src7"}


@query(f"WITH corpus AS ({fx.SQL['files']}), {_chunk_sql(80, 20, True)}, {_score_sql({0: 'token the'})} SELECT rank::INT AS rank, filepath, start_line, end_line, round(score, 6) AS score, sha256(raw_snippet) AS sha256 FROM ranked WHERE rank <= 20")
def q20_chunk_search(spark, sf_dir):
    hits = rank.search(_index(spark, sf_dir, "files", Settings()), {0: "token the"}, 20, diversify=False)
    return hits.select("rank", "filepath", "start_line", "end_line", F.round("score", 6).alias("score"), F.sha2("raw_snippet", 256).alias("sha256"))


@query(f"""WITH RECURSIVE corpus AS ({fx.SQL['files']}), {_chunk_sql(10, 3, True)}, {_score_sql({0: 'token the'})},
pool AS (SELECT * FROM ranked WHERE rank <= 30),
walk AS (
  SELECT 0::BIGINT AS step, []::STRUCT(f VARCHAR, s INT, r BIGINT)[] AS kept
  UNION ALL
  SELECT step + 1, CASE WHEN len(list_filter(kept, lambda k: k.f = pool.filepath AND abs(k.s - pool.start_line) < 7)) > 0 THEN kept
    ELSE list_append(kept, struct_pack(f := pool.filepath, s := pool.start_line, r := pool.rank)) END
  FROM walk JOIN pool ON pool.rank = step + 1),
fin AS (SELECT unnest(kept) AS k FROM (SELECT kept FROM walk ORDER BY step DESC LIMIT 1))
SELECT row_number() OVER (ORDER BY pool.rank)::INT AS rank, filepath, start_line, round(score, 6) AS score FROM pool JOIN fin ON fin.k.r = pool.rank QUALIFY row_number() OVER (ORDER BY pool.rank) <= 10""")
def q21_diversified_search(spark, sf_dir):
    hits = rank.search(_index(spark, sf_dir, "files", SMALL), {0: "token the"}, 10, settings=SMALL)
    return hits.select("rank", "filepath", "start_line", F.round("score", 6).alias("score"))


@query(f"""WITH {_whole('docs')}, {_score_sql(_MULTI)}, hits AS (SELECT * FROM ranked WHERE rank <= 20),
f AS (SELECT filepath, sum(1.0::DOUBLE / (60 + rank)) AS fusion, min(score) AS score, min(q * 1000 + rank) AS place, count(*) AS n_matched FROM hits GROUP BY filepath)
SELECT row_number() OVER (ORDER BY round(fusion, 12) DESC, place)::INT AS rank, filepath, round(score, 6) AS score, round(fusion, 9) AS fusion_score, n_matched::INT AS n_matched
FROM f QUALIFY row_number() OVER (ORDER BY round(fusion, 12) DESC, place) <= 5""")
def q22_fused_search(spark, sf_dir):
    hits = rank.search(_index(spark, sf_dir, "docs"), _MULTI, 20)
    out = post.fused(hits, _MULTI, 5)
    return out.select("rank", "filepath", F.round("score", 6).alias("score"), F.round("fusion_score", 9).alias("fusion_score"), F.size("matched_queries").alias("n_matched"))


_JUDGED = {0: "token", 1: "idiot loser", 2: "the", 3: "src7 token"}


@query(f"""WITH {_whole('docs')}, {_score_sql(_JUDGED)},
t AS (SELECT q, count(*) AS n, max(score) FILTER (rank = 1) AS x, max(score) FILTER (rank = 2) AS y FROM ranked WHERE rank <= 10 GROUP BY q)
SELECT q::INT AS q, CASE WHEN n = 1 THEN 'single' WHEN abs(x) / abs(y) >= 1.5 THEN 'dominant' ELSE 'close_contest' END AS label,
round(x, 6) AS top_score, round(y - x, 6) AS score_gap, n < 4 OR x > -1.0 AS hint FROM t""")
def q23_confidence(spark, sf_dir):
    hits = rank.search(_index(spark, sf_dir, "docs"), _JUDGED, 10, diversify=False)
    n = hits.groupBy("q").agg(F.count("*").alias("n"))
    out = post.confidence(hits).join(n, "q")
    return out.select("q", "label", F.round("top_score", 6).alias("top_score"), F.round("score_gap", 6).alias("score_gap"), post.needs_hint(F.col("n"), F.col("top_score"), 10).alias("hint"))


# Snapshots -------------------------------------------------------------------------------------------------


def _snapshots(spark, sf_dir):
    d = fx.read(spark, sf_dir, "documents").select(F.format_string("docs/%s/%s_%s.md", "lang", "source", F.col("doc_id").cast("string")).alias("filepath"), "text", "doc_id")
    i = F.col("doc_id")
    hashed = lambda df: df.select("filepath", F.lit(1.0).alias("mtime"), F.sha2("text", 256).alias("file_hash"), "text")
    new = d.where(i % 7 != 0).withColumn("text", F.when(i % 5 == 0, F.concat("text", F.lit("\nchanged"))).otherwise(F.col("text")))
    return hashed(d.where(i % 11 != 0)), hashed(new)


_NEW = "SELECT doc_id, 'docs/' || lang || '/' || source || '_' || doc_id || '.md' AS filepath, CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || 'changed' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0"


@query("""SELECT 'docs/' || lang || '/' || source || '_' || doc_id || '.md' AS filepath,
CASE WHEN doc_id % 11 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'deleted' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS action
FROM documents WHERE NOT (doc_id % 11 = 0 AND doc_id % 7 = 0)""")
def q24_snapshot_diff(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return changes(old, new)


_LINES_OF = "CASE doc_id % 8 WHEN 0 THEN 'D' || t || p WHEN 1 THEN 'R100' || t || 'old/' || p || t || p WHEN 2 THEN 'C75' || t || 'from/' || p || t || p WHEN 3 THEN 'M' || t || p WHEN 4 THEN 'A' || t || p WHEN 5 THEN 'T' || t || p WHEN 6 THEN 'X' || t || p ELSE 'M ' || p END"


@query("""WITH d AS (SELECT doc_id, 'docs/' || lang || '/' || source || '_' || doc_id || '.md' AS p FROM documents)
SELECT p AS filepath, CASE WHEN doc_id % 8 = 0 THEN 'deleted' ELSE 'changed' END AS action FROM d UNION ALL SELECT 'old/' || p, 'deleted' FROM d WHERE doc_id % 8 = 1""")
def q25_name_status(spark, sf_dir):
    d = fx.read(spark, sf_dir, "documents").select("doc_id", F.format_string("docs/%s/%s_%s.md", "lang", "source", F.col("doc_id").cast("string")).alias("p"), F.lit("\t").alias("t"))
    return name_status(d.select(F.expr(_LINES_OF).alias("line")))


@query(f"WITH corpus AS (SELECT filepath, text FROM ({_NEW})), {_chunk_sql(80, 20, True)} SELECT filepath, start_line, end_line, sha256(raw_snippet) AS sha256 FROM chunks")
def q26_sync_is_rebuild(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    out = resynced(chunks(old), changes(old, new), new)
    return out.select("filepath", "start_line", "end_line", F.sha2("raw_snippet", 256).alias("sha256"))


def _synced(spark, sf_dir) -> Store:
    """A stored index of the old snapshot that has taken over the new one."""
    old, new = _snapshots(spark, sf_dir)
    store = Store(spark, "", scratch(spark, "catalogue"))
    store.update(old)
    diff = store.staged(changes(old, new), "catalogue-diff")
    store.update(store.staged(new.join(diff.where("action in ('added', 'changed')"), "filepath", "left_semi"), "catalogue-new"), diff.where("action = 'deleted'"))
    return store


_SNAP = f"corpus AS (SELECT filepath, text FROM ({_NEW})), {_chunk_sql(80, 20, True)}"


@query(f"WITH {_SNAP}, {_score_sql({0: 'token the', 1: 'src7 changed'})} SELECT q, rank::INT AS rank, filepath, start_line, round(score, 6) AS score FROM ranked WHERE rank <= 20")
def q34_synced_search(spark, sf_dir):
    hits = rank.search(_synced(spark, sf_dir).index(), {0: "token the", 1: "src7 changed"}, 20, diversify=False)
    return hits.select("q", "rank", "filepath", "start_line", F.round("score", 6).alias("score"))


@query(f"WITH {_SNAP}, {_terms_sql()}, t AS (SELECT filepath, start_line, 0 AS col, unnest(p) AS term FROM terms UNION ALL SELECT filepath, start_line, 1 AS col, unnest(b) AS term FROM terms) SELECT term, count(*) AS times, count(DISTINCT filepath || '#' || start_line) AS df FROM t GROUP BY term")
def q35_synced_postings(spark, sf_dir):
    return _synced(spark, sf_dir).index().terms().groupBy("term").agg(F.sum("times").alias("times"), F.sum("df").alias("df"))


@query(f"""WITH {_SNAP}, {_terms_sql()}, n AS (SELECT filepath, count(*) AS n_chunks, sum(len(p) + len(b))::BIGINT AS total_length FROM terms GROUP BY filepath)
SELECT corpus.filepath, sha256(text) AS file_hash, coalesce(n_chunks, 0) AS n_chunks, coalesce(total_length, 0) AS total_length, (SELECT count(*) FROM chunks) AS all_chunks FROM corpus LEFT JOIN n USING (filepath)""")
def q36_synced_files(spark, sf_dir):
    store = _synced(spark, sf_dir)
    n = store.chunks().groupBy("filepath").agg(F.count("*").alias("n_chunks"), F.sum("dl").alias("total_length"))
    out = store.metadata().join(n, "filepath", "left").na.fill(0, ["n_chunks", "total_length"])
    return out.select("filepath", "file_hash", "n_chunks", "total_length", F.lit(store.count_chunks()).cast("long").alias("all_chunks"))


@query(f"""WITH {_SNAP}, n AS (SELECT filepath, count(*) AS n_chunks FROM chunks GROUP BY filepath)
SELECT corpus.filepath, sha256(text) AS file_hash, coalesce(n_chunks, 0) AS n_chunks FROM corpus LEFT JOIN n USING (filepath)""")
def q38_followed_index(spark, sf_dir):
    """A stream of changes, taken over by an index in two goes."""
    old, new = _snapshots(spark, sf_dir)
    folder = scratch(spark, "followed")
    store = Store(spark, "", f"{folder}/index")
    diff = store.staged(changes(old, new), "followed-diff")
    row = lambda df, time: df.select("filepath", F.lit(time).alias("mtime"), "text", F.lit(False).alias("deleted"))
    gone = diff.where("action = 'deleted'").select("filepath", F.lit(2.0).alias("mtime"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("deleted"))
    later = row(new.join(diff.where("action in ('added', 'changed')"), "filepath", "left_semi"), 2.0)
    for n, rows in enumerate((row(old, 1.0), later.unionByName(gone))):
        write(rows, f"{folder}/changes/n={n}")
        stream = spark.readStream.schema(CHANGES).parquet(f"{folder}/changes/*")
        follow(store, stream, f"{folder}/checkpoint", availableNow=True).awaitTermination()
    n = store.chunks().groupBy("filepath").agg(F.count("*").alias("n_chunks"))
    return store.metadata().join(n, "filepath", "left").na.fill(0, ["n_chunks"]).select("filepath", "file_hash", "n_chunks")


@query("SELECT doc_id, lang, sha256(text) AS sha256 FROM documents")
def q39_listed_tree(spark, sf_dir):
    """The documents as files of a tree, listed and read by tasks."""
    root = scratch(spark, "tree")
    fx.read(spark, sf_dir, "documents").select("doc_id", "lang", "text").write.partitionBy("lang").json(root)
    rows = read_files(spark, root).select("filepath", F.explode(F.split("text", "\n")).alias("line")).where("line != ''")
    doc = rows.select(F.regexp_extract("filepath", "^lang=([^/]*)/", 1).alias("lang"), F.from_json("line", "doc_id long, text string").alias("d"))
    return doc.select("d.doc_id", "lang", F.sha2("d.text", 256).alias("sha256"))


@query(f"WITH corpus AS ({fx.SQL['files']}), {_chunk_sql(80, 20, True)} SELECT filepath, count(*) AS n_chunks FROM chunks GROUP BY filepath")
def q27_chunk_counts(spark, sf_dir):
    return chunks(fx.files(spark, sf_dir)).groupBy("filepath").agg(F.count("*").alias("n_chunks"))


# Answers ---------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT doc_id, text, unnest(range(1, least(length(text), 101) + 1)) AS i FROM documents),
s AS (SELECT doc_id, i, text, sum(strlen(substr(text, i::INT, 1))) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM c)
SELECT d.doc_id, coalesce(max(substr(s.text, 1, s.i::INT)), '') AS cut FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id AND upto <= 101 GROUP BY d.doc_id""")
def q28_byte_truncation(spark, sf_dir):
    return fx.read(spark, sf_dir, "documents").select("doc_id", tx.truncated(F.col("text"), 101).alias("cut"))


@query(f"""WITH {_whole('docs')}, {_score_sql({0: 'token the'})}, hits AS (SELECT * FROM ranked WHERE rank <= 5),
j AS (SELECT count(*) AS n, max(score) FILTER (rank = 1) AS x, max(score) FILTER (rank = 2) AS y FROM hits)
SELECT 'ok' AS status, n AS count, CASE WHEN n = 1 THEN 'single' WHEN abs(x) / abs(y) >= 1.5 THEN 'dominant' ELSE 'close_contest' END AS label, n < 2 OR x > -1.0 AS hint,
rank::INT AS rank, filepath, round(score, 6) AS score, sha256(raw_snippet) AS sha256 FROM hits, j""")
def q40_json_answer(spark, sf_dir):
    """A JSON answer, read back."""
    answer = render(find(_index(spark, sf_dir, "docs"), "token the"), "json", None, "token the", 5)
    schema = "status string, count long, confidence struct<label string>, low_confidence_hint string, results array<struct<filepath string, score double, raw_snippet string>>"
    d = spark.createDataFrame([(answer,)], "text string").select(F.from_json("text", schema).alias("a")).select("a.*")
    rows = d.select("status", "count", "confidence.label", F.col("low_confidence_hint").isNotNull().alias("hint"), F.posexplode("results").alias("pos", "r"))
    return rows.select("status", "count", "label", "hint", (F.col("pos") + 1).alias("rank"), "r.filepath", F.round("r.score", 6).alias("score"), F.sha2("r.raw_snippet", 256).alias("sha256"))


@query(f"""WITH {_whole('docs')}, {_score_sql({0: 'token'})}, hits AS (SELECT * FROM ranked WHERE rank <= 5),
judged AS (SELECT count(*) AS n, max(score) FILTER (rank = 1) AS x, max(score) FILTER (rank = 2) AS y FROM hits),
body AS (SELECT string_agg('## ' || rank || '. ' || filepath || ' (lines ' || start_line || '-' || end_line || ')' || chr(10) || printf('score: %.6f', score) || chr(10) || chr(10)
  || '```' || chr(10) || raw_snippet || chr(10) || '```', chr(10) || chr(10) ORDER BY rank) AS blocks FROM hits)
SELECT 'token' AS query, '# BM25 Search Results' || chr(10) || chr(10) || '**Query:** `token`' || chr(10) || chr(10) || CASE WHEN n = 0 THEN '{ZERO_MATCH}' ELSE
  '**Confidence:** ' || CASE WHEN n = 1 THEN 'single' WHEN abs(x) / abs(y) >= 1.5 THEN 'dominant' ELSE 'close_contest' END
  || CASE WHEN n = 1 THEN '' ELSE printf(' (top: %.6f, runner-up: %.6f, gap: %.6f)', x, y, y - x) END || chr(10)
  || CASE WHEN n < 2 OR x > -1.0 THEN '**Hint:** {HINT}' || chr(10) ELSE '' END || chr(10) || blocks || chr(10) END AS answer FROM judged, body""")
def q29_markdown(spark, sf_dir):
    hits = find(_index(spark, sf_dir, "docs"), "token")
    return spark.createDataFrame([("token", render(hits, "markdown", None, "token", 5))], "query string, answer string")


@query(f"SELECT 'qqzzxx' AS query, 'zero_match' AS status, '{ZERO_MATCH}' AS message")
def q30_zero_match(spark, sf_dir):
    hits = rank.search(_index(spark, sf_dir, "docs"), {0: "qqzzxx"}, 5).agg(F.count("*").alias("n"))
    return hits.where("n = 0").select(F.lit("qqzzxx").alias("query"), F.lit("zero_match").alias("status"), F.lit(ZERO_MATCH).alias("message"))
