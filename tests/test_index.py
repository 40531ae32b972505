"""Blocks, bounds, masks, merges, listing by tasks, streams of changes, indexes that begin as others."""

import os
import random
import re
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from siftline.config import Settings
from siftline.functions import tokenize as tk
from siftline.operators import index as ix
from siftline.operators import rank
from siftline.operators.chunk import chunks
from siftline.serving import adapter, service
from siftline.sources import files as src
from siftline.sources import listing
from siftline.streaming import follow
from siftline.streaming.sync import FAN_IN, EmptyTree, Store, due

FILES = "filepath string, mtime double, file_hash string, text string"
WORDS = [f"w{i}" for i in range(30)]


def corpus(n, seed):
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choice(WORDS[: rng.choice([3, 10, 30])]) for _ in range(rng.choice([5, 20, 60]))) + rng.choice(["", " w1_w2 w2_w1"])
    return [(f"d/w{i % 7}_{i}.md", 1.0, "h", text()) for i in range(n)]


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    """An index with several segments and gone chunks, and one built anew of the same files."""
    folder = tmp_path_factory.mktemp("stores")
    rows = {r[0]: r for r in corpus(500, 1)}
    store = Store(spark, "", f"file://{folder}/a")
    store.update(spark.createDataFrame([*rows.values()], FILES))
    changed = {r[0]: r for r in corpus(500, 2)[::9]}
    gone = list(rows)[5::11]
    store.update(spark.createDataFrame([*changed.values()], FILES), spark.createDataFrame([(p,) for p in gone if p not in changed], "filepath string"))
    now = {p: r for p, r in (rows | changed).items() if p in changed or p not in gone}
    fresh = Store(spark, "", f"file://{folder}/b")
    fresh.update(spark.createDataFrame([*now.values()], FILES))
    return store, fresh


def hits(found):
    return [(r.q, r["rank"], r.filepath, round(r.score, 9)) for r in found.orderBy("q", "rank").collect()]


QUERIES = {0: "w1", 1: "w2 w17 w17", 2: "w0 w1 w2", 3: "w29 nothing", 4: "w5 w6"}


@pytest.mark.parametrize("mode", ["OR", "AND"])
def test_search_by_bounds_is_whole(spark, stores, monkeypatch, mode):
    store, fresh = stores
    assert len(store.manifest().segments) == 2 and store.manifest().dead and store.count_chunks() == fresh.count_chunks()
    want = hits(rank.search(fresh.index(), QUERIES, 7, mode, diversify=False))
    for pruned, many in ((10**9, 20_000), (0, 20_000), (0, 40), (10**9, 3)):  # with and without bounds, named by the driver or joined
        monkeypatch.setattr(rank, "PRUNED", pruned)
        monkeypatch.setattr(rank, "MANY", many)
        assert hits(rank.search(store.index(), QUERIES, 7, mode, diversify=False)) == want
    assert len({q for q, *_ in want}) == (5 if mode == "OR" else 4)


def test_bounds_hold(spark, stores):
    for store in stores:
        search = rank.Search(store.index(), QUERIES)
        best = search.scored().groupBy("q", "segment", ix.range_of(F.col("no")).alias("range")).agg(F.min("score").alias("score"))
        both = best.join(search.bounds(), ["q", "segment", "range"], "left").collect()
        assert both and all(r.bound is not None and r.bound >= -r.score - 1e-12 for r in both)


def test_bounds_of_one_term_are_reached(spark, stores):
    for term, more in (("w25", 0), ("w0", 3)):  # the scores of a common term are so small that more of them are ties
        read, every = rank.blocks_read(stores[1].index(), {0: term}, 3)
        assert 0 < read <= 3 + more < every


def test_phrases_in_blocks(spark, stores):
    store, fresh = stores
    for q in ({0: "w1_w2"}, {0: "w2_w1 w3", 1: "w1_w2 w2_w1"}):
        got = hits(rank.search(store.index(), q, 9, diversify=False))
        assert got and got == hits(rank.search(fresh.index(), q, 9, diversify=False))
    index = fresh.index()
    _, found = index.look_up(["w1", "w2"])
    rows = {(r.segment, r.range * ix.RANGE + d.at): d.tf for r in rank.phrase_rows(found, {("w1", "w2"): 0}).collect() for d in r.docs}
    want = {}
    for r in index.chunks().select("segment", "no", "path_terms", "body_terms").collect():
        n = sum(w * sum(t[i : i + 2] == ["w1", "w2"] for i in range(len(t))) for t, w in ((r.path_terms, 3.0), (r.body_terms, 1.0)))
        if n:
            want[r.segment, r.no] = n
    assert rows == want


def test_dictionary_follows_chunks(spark, stores):
    """Its numbers are those of an index built anew; what is gone is subtracted."""
    sums = lambda s: {r.term: (r.df, r.times) for r in s.index().terms().groupBy("term").agg(F.sum("df").alias("df"), F.sum("times").alias("times")).collect()}
    assert sums(stores[0]) == sums(stores[1])


def test_plans_read_what_they_need(spark, stores):
    """No join or pattern over postings, buckets of the terms only, and chunks by number."""
    store, _ = stores
    index = store.index()
    _, found = index.look_up(["w1"])
    files = {f.split("/blocks/")[1].split("/")[0] for f in found.inputFiles()}
    assert len(files) == 1
    some = index.chunks().select("segment", "no").limit(3).collect()
    numbers = {}
    for r in some:
        numbers.setdefault(r.segment, []).append(r.no)
    got = index.fetch(numbers)
    assert {(r.segment, r.no) for r in got.collect()} == {(r.segment, r.no) for r in some}
    plan = got._jdf.queryExecution().toString()
    assert "PushedFilters: [In(no" in plan or "PushedFilters: [EqualTo(no" in plan or "Or(EqualTo(no" in plan
    assert all(f"task={n >> ix.TASK_BITS}/" in "".join(got.inputFiles()) for ns in numbers.values() for n in ns)
    assert "rlike" not in found._jdf.queryExecution().toString().lower()


def test_merges_grow_as_n_log_n():
    rng = random.Random(1)
    segments, written, n = {}, 0, 0
    for i in range(640):
        segments[f"s{i}"] = {"n": 10, "gone": 0}
        written, n = written + 10, n + 10
        if rng.random() < 0.3:
            s = rng.choice(list(segments))
            take = min(3, segments[s]["n"] - segments[s]["gone"])
            segments[s] = segments[s] | {"gone": segments[s]["gone"] + take}
            n -= take
        if once := due(segments):
            live = sum(segments[s]["n"] - segments[s]["gone"] for s in once)
            segments = {s: x for s, x in segments.items() if s not in once}
            if live:
                segments[f"m{i}"] = {"n": live, "gone": 0}
                written += live
        assert len(segments) <= 3 * 8
    assert sum(x["n"] - x["gone"] for x in segments.values()) == n
    assert written <= n * 8 and FAN_IN == 4  # a rewrite for each tier: log4 of 640, and those that were half gone


def test_merged_segments_search_alike(spark, tmp_path):
    rows = corpus(60, 5)
    store, fresh = Store(spark, "", f"file://{tmp_path}/a"), Store(spark, "", f"file://{tmp_path}/b")
    for i in range(0, 60, 15):
        store.update(spark.createDataFrame(rows[i : i + 15], FILES))
    fresh.update(spark.createDataFrame(rows, FILES))
    assert len(store.manifest().segments) == 1  # four of like size became one
    assert hits(rank.search(store.index(), QUERIES, 5)) == hits(rank.search(fresh.index(), QUERIES, 5))


# trees


def tree(root):
    for name, text in {"a.py": "alpha", "b/c.md": "beta", "b/d/e/f.md": "gamma", "b/empty.py": "", "g.bin": "no", "node_modules/h.py": "no", ".git2/i.py": "iota", "j k [x] é.md": "kappa", "x/.md": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    for i in range(40):
        (root / f"many/{i}").mkdir(parents=True)
        (root / f"many/{i}/z.py").write_text(f"zeta z{i}")
    os.symlink(root / "b", root / "linked")
    os.symlink(root / "a.py", root / "b/same.py")


def walked(root):
    out = set()
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in listing.SKIPPED]
        out |= {os.path.relpath(os.path.join(folder, n), root) for n in names}
    return {p for p in out if src.matches(p)}


def test_listing_by_tasks(spark, tmp_path, monkeypatch):
    tree(tmp_path)
    for root in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/"):
        rows = listing.listing(spark, root).collect()
        assert len(rows) == len({r.filepath for r in rows})
        assert all((r.size, r.mtime) == ((s := os.stat(tmp_path / r.filepath)).st_size, s.st_mtime_ns // 1_000_000 / 1000) for r in rows)
        assert {*src.collect_files(spark, root)} == walked(tmp_path)
        texts = {r.filepath: r.text for r in src.read_files(spark, root).collect()}
        assert texts == {p: (tmp_path / p).read_text() for p in walked(tmp_path)}
    assert listing.listing(spark, str(tmp_path)).rdd.getNumPartitions() > 4
    with pytest.raises(FileNotFoundError):
        listing.listing(spark, f"{tmp_path}/nothing")
    assert src.read_files(spark, str(tmp_path), ["a.py", "gone.py", "b"]).select("filepath").collect() == [("a.py",)]
    monkeypatch.setattr(listing, "_by_spark", lambda root: True)  # a file system that only Spark opens; links aside
    os.unlink(tmp_path / "linked")
    root = f"file:{tmp_path}"
    assert {*src.collect_files(spark, root)} == walked(tmp_path) - {".git2/i.py", "b/empty.py"}
    assert {r.filepath: r.text for r in src.read_files(spark, root, ["a.py", "b/c.md"]).collect()} == {"a.py": "alpha", "b/c.md": "beta"}


def test_sync_of_a_root_with_a_scheme(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        tree(tmp_path / name)
    plain, uri = Store(spark, f"{tmp_path}/one", f"file://{tmp_path}/i"), Store(spark, f"file://{tmp_path}/two", f"file://{tmp_path}/two/.index")
    told = lambda r: {k: r[k] for k in ("full_build", "files", "updated", "deleted", "updated_files", "deleted_files", "chunks")}
    assert told(plain.sync()) == told(uri.sync())  # the index's own folder in the tree isn't listed
    for name in ("one", "two"):
        (tmp_path / name / "a.py").write_text("alpha again")
        (tmp_path / name / "b/c.md").unlink()
    assert told(plain.sync()) == told(uri.sync()) and plain.metadata().count() == uri.metadata().count()
    find = lambda s: [(r.filepath, round(r.score, 9)) for r in s.search("again zeta z7").orderBy("rank").collect()]
    assert find(plain) == find(uri) != []
    os.rename(tmp_path / "two", tmp_path / "away")
    moved = Store(spark, f"file://{tmp_path}/two", f"file://{tmp_path}/away/.index")
    with pytest.raises(FileNotFoundError):
        moved.sync()
    (tmp_path / "two").mkdir()
    with pytest.raises(EmptyTree):
        moved.sync()
    assert moved.count_chunks() == uri.__class__(spark, "", f"file://{tmp_path}/away/.index").count_chunks() > 0
    assert moved.sync(allow_empty=True)["deleted"] > 0 and moved.count_chunks() == 0


# streams


def test_follow_a_stream(spark, tmp_path, monkeypatch):
    change = lambda name, *rows: spark.createDataFrame(rows, follow.CHANGES).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/changes/{name}")
    change("n=1", ("a.md", 1.0, "alpha", None), ("b.md", 1.0, "beta", False), ("b.md", 2.0, "beta two", False), (None, 1.0, "x", False), ("c.md", 1.0, None, False))
    store = Store(spark, "", f"file://{tmp_path}/i")
    stream = spark.readStream.schema(follow.CHANGES).parquet(f"file://{tmp_path}/changes/*")
    run = lambda: follow.follow(store, stream, f"file://{tmp_path}/checkpoint", availableNow=True).awaitTermination()
    run()
    assert {r.filepath for r in store.files().collect()} == {"a.md", "b.md"} and store.metadata().count() == 3
    assert [r.raw_snippet for r in store.search("two").collect()] == ["beta two"]
    generation, publish = store.manifest().generation, ix.Manifest.publish

    def dies_before(self, *a):
        raise RuntimeError("killed before it published")

    def dies_after(self, *a):
        publish(self, *a)
        raise RuntimeError("killed after it published")

    for n, dies in ((2, dies_before), (3, dies_after)):
        change(f"n={n}", ("a.md", 3.0 + n, None, True), (f"d{n}.md", 3.0, f"delta d{n}", False))
        monkeypatch.setattr(ix.Manifest, "publish", dies)
        with pytest.raises(Exception, match="killed"):
            run()
        monkeypatch.setattr(ix.Manifest, "publish", publish)
        run()
        assert store.manifest().generation == generation + n - 1  # once, whether it had been published or not
        assert [r.raw_snippet for r in store.search(f"d{n}").collect()] == [f"delta d{n}"]
    assert {r.filepath for r in store.files().collect()} == {"b.md", "d2.md", "d3.md"} and store.count_chunks() == 3
    assert not follow.take(store, spark.createDataFrame([("z.md", 9.0, "zeta", False)], follow.CHANGES), 1) and store.count_chunks() == 3


# indexes that begin as others


def test_lent_index(spark, tmp_path):
    rows = corpus(30, 7)
    parent, child, third = (Store(spark, "", f"{scheme}{tmp_path}/{n}") for n, scheme in zip("abc", ("file://", "file:", "file://"), strict=True))
    parent.update(spark.createDataFrame(rows, FILES))
    assert parent.copy_to(child.folder) and child.copy_to(third.folder) and not [n for n in os.listdir(tmp_path / "b") if n.startswith("segment")]
    found = lambda s, q="w11 w12 w13": hits(rank.search(s.index(), {0: q}, 5))
    want = found(parent)
    assert found(child) == found(third) == want != []
    child.update(spark.createDataFrame([("d/new.md", 1.0, "h", "w1 own")], FILES), spark.createDataFrame([(rows[0][0],)], "filepath string"))
    for i in range(3):  # all of the parent's own is replaced, twice over
        parent.update(spark.createDataFrame([(p, 2.0, "h", f"changed {i}") for p, *_ in rows], FILES))
    assert found(parent) == [] and len(found(parent, "changed")) == 5
    assert found(third) == want and [h[2] for h in found(child, "own")] == ["d/new.md"] and child.count_chunks() == 30
    for s in (child, third):  # what nobody refers to any more goes
        for i in range(3):
            s.update(spark.createDataFrame([(p, 3.0, "h", f"mine {i}") for p, *_ in rows], FILES))
    parent.set_state("k", "v")
    parent.set_state("k", "w")
    kept = [n for n in os.listdir(tmp_path / "a") if n.startswith(("segment", "lent"))]
    assert len(kept) == len(parent.manifest().segments) and len(found(third, "mine")) == 5


# marks and services


def test_marks_in_paths(spark):
    names = ["école/Über_Ñandú.md", "Đo/ŁódŹ-ŷ", "日本語/が.md", "plain/a.md"]
    rows = spark.createDataFrame([(n, form, unicodedata.normalize(form, n)) for n in names[:2] for form in ("NFC", "NFD")], "name string, form string, path string")
    got = {(r.name, r.form): r.terms for r in rows.select("name", "form", tk.path_terms(F.col("path")).alias("terms")).collect()}
    assert got[names[0], "NFC"] == got[names[0], "NFD"] == ["ecole", "uber", "nandu", "md"] and got[names[1], "NFC"] == got[names[1], "NFD"]
    assert tk.query_phrases("È") == tk.query_phrases(unicodedata.normalize("NFD", "È")) == [("e",)]


def test_places_of_roots_with_a_scheme():
    assert service.places("hdfs://n/x/", None) == ("hdfs://n/x/", "hdfs://n/x/.siftline") and service.places("s3://b/x", "/tmp/i") == ("s3://b/x", "file:///tmp/i")


def test_resident_service(monkeypatch):
    echo = "import sys, json\nfor line in sys.stdin:\n    m = json.loads(line); q = m['params']['arguments']['query']\n    if q == 'end': break\n    if q == 'wait': import time; time.sleep(30)\n    print('noise', flush=True)\n    print(json.dumps({'id': m['id'], 'result': {'structuredContent': {'results': [{'filepath': q, 'start_line': 1, 'end_line': 1, 'raw_snippet': 'x', 'score': -2.0}]}}}), flush=True)"
    start = adapter.subprocess.Popen
    monkeypatch.setattr(adapter.subprocess, "Popen", lambda line, **more: start([sys.executable, "-c", echo], **more))
    adapter._service.cache_clear()
    first = adapter.call({"query": "one.py"}, db="/i")
    assert not first["isError"] and "one.py" in first["content"][0]["text"]
    service = adapter.resident("/i")
    assert "two.py" in adapter.call({"query": "two.py"}, db="/i")["content"][0]["text"] and adapter.resident("/i") is service
    assert adapter.call({"query": "end"}, db="/i")["isError"]
    service.process.wait()
    assert not adapter.call({"query": "three.py"}, db="/i")["isError"] and adapter.resident("/i") is not service
    late = adapter.call({"query": "wait"}, db="/i", timeout=0.5)
    assert late["isError"] and "timeout" in late["content"][0]["text"]
    adapter.resident("/i").close()
    adapter._service.cache_clear()


def test_range_blocks_are_those_of_occurrences(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "SLICE_ROWS", 300)  # many slices, and ranges longer than one
    text = lambda i: " ".join(f"w{(i * j) % 17}" for j in range(i % 23)) + (" getUserName a_b 認証設定" if i % 5 == 0 else "")
    rows = [(f"d{i % 3}/w1_{i}.md", 1, 1, text(i)) for i in range(300)] + [("", 1, 1, "")]
    made = spark.createDataFrame(rows, "filepath string, start_line int, end_line int, raw_snippet string").repartition(3)
    table = ix.write_chunks(made, f"file://{tmp_path}/chunks")
    for settings in (ix.DEFAULT, Settings(path_weight=0.1, body_weight=0.3)):
        want = {(r.term, r.range): r for r in ix.blocks(ix.occurrences(table), settings=settings).collect()}
        got = {(r.term, r.range): r for r in ix.range_blocks(table, settings).collect()}
        assert got == want
    words = {r.term: r[:] for r in ix.dictionary(ix.range_blocks(table, postings=False)).collect()}
    assert words == {r.term: r[:] for r in ix.dictionary(ix.blocks(ix.occurrences(table))).collect()}


def test_index_moves_no_occurrences(spark, monkeypatch, tmp_path):
    """A segment and a dictionary are made of chunks and blocks; occurrences are rows only for the terms that are asked."""
    monkeypatch.setattr(ix, "occurrences", None)
    monkeypatch.setattr(ix, "TASK_ROWS", 50)  # buckets dealt to several tasks
    rows = [(f"w{i}", 1, 1, " ".join(["same"] * 20 + [f"x{i % 7}"])) for i in range(200)]
    made = spark.createDataFrame(rows, "filepath string, start_line int, end_line int, raw_snippet string")
    ix.replace(made, f"file://{tmp_path}/index")
    got = {r.term: (r.df, r.times) for r in ix.Index.open(spark, f"file://{tmp_path}/index").terms().collect()}
    assert got == {r.term: (r.df, r.times) for r in ix.Index.of(made).terms().collect()}
    assert got["same"] == (200, 4000)


def test_fetch_compares_pages_with_each_number(spark):
    rows = [(f"f{i:03d}", 1, 1, f"same t{i}") for i in range(200)]
    index = ix.Index.of(spark.createDataFrame(rows, "filepath string, start_line int, end_line int, raw_snippet string").repartition(4))
    numbers = [r.no for r in index.chunks().collect()][::9]
    got = index.fetch({"": numbers})
    assert sorted(r.no for r in got.collect()) == sorted(numbers)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    lists = re.findall(r"no#\d+L (?:IN|INSET) \(?([\d, ]*)", plan)
    assert lists and all(len(x.split(",")) <= 10 for x in lists)  # longer ones become a span from the least to the largest
    hits = rank.best(index, {0: "same"}, 20)
    assert hits.count() == 20 and "Coalesce 1" not in hits._jdf.queryExecution().toString()


CHUNK = "filepath string, start_line int, end_line int, raw_snippet string"


def test_blocks_are_made_once(spark, monkeypatch, tmp_path):
    """A segment's blocks go from the tasks that make them to the buckets, which are dealt to several tasks where they are large; no table of them stands between."""
    monkeypatch.setattr(ix, "scratch", None)
    monkeypatch.setattr(ix, "TASK_ROWS", 500)
    monkeypatch.setattr(ix, "TASK_BYTES", 2000)
    before = spark.conf.get(ix.TASK_SIZE)
    chunks_ = spark.createDataFrame([(f"w{i}", 1, 1, " ".join(["same"] * 20 + [f"x{i % 7}"])) for i in range(2000)], CHUNK)
    ix.replace(chunks_, f"file://{tmp_path}/index")
    assert spark.conf.get(ix.TASK_SIZE) == before
    index = ix.Index.open(spark, f"file://{tmp_path}/index")
    made, want = index.look_up(["same", "x3"])[1].drop("segment"), ix.blocks(ix.occurrences(index.chunks()).where("term in ('same', 'x3')"))
    assert {(r.term, r.range): r for r in made.collect()} == {(r.term, r.range): r for r in want.select(made.columns).collect()}
    assert any(len(files) > 4 for folder, _, files in os.walk(f"{tmp_path}/index") if "/bucket=" in folder)  # each with a checksum


def test_many_numbers_are_a_relation(spark, monkeypatch):
    monkeypatch.setattr(ix, "EXACT", 20)
    index = ix.Index.of(spark.createDataFrame([(f"f{i:03d}", 1, 1, f"same t{i}") for i in range(200)], CHUNK).repartition(4))
    numbers = [r.no for r in index.chunks().collect()][::5]
    got = index.fetch({"": numbers})
    assert sorted(r.no for r in got.collect()) == sorted(numbers)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and not re.search(r"no#\d+L (IN|INSET)", plan)


def test_gone_terms_are_counted_in_tasks(spark, stores, monkeypatch):
    """Where more chunks are gone than the driver names, too; no row is an occurrence."""
    store = stores[0]
    live = store.chunks()
    want = live.select("segment", "no", F.explode(F.concat("path_terms", "body_terms")).alias("term")).groupBy("segment", "term").agg(F.countDistinct("no").alias("df"), F.count("*").alias("times"))
    monkeypatch.setattr(ix, "COUNTED", 7)
    got = ix.term_counts(live)
    assert {r[:] for r in got.collect()} == {r[:] for r in want.collect()}
    assert "Explode" not in got._jdf.queryExecution().toString() and "Generate" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("many", [0, 20_000])
def test_forgetting_more_than_once(spark, monkeypatch, tmp_path, many):
    monkeypatch.setattr(rank, "MANY", many)
    store = Store(spark, "", f"file://{tmp_path}/a")
    rows = {r[0]: r for r in corpus(300, 3)}
    store.update(spark.createDataFrame([*rows.values()], FILES))
    for part in (2, 5):
        store.update(spark.createDataFrame([], FILES), spark.createDataFrame([(p,) for p in list(rows)[part::9]], "filepath string"))
    left = {p: r for i, (p, r) in enumerate(rows.items()) if i % 9 not in (2, 5)}
    whole = Store(spark, "", f"file://{tmp_path}/b")
    whole.update(spark.createDataFrame([*left.values()], FILES))
    words = lambda s: {(r.term, r.df, r.times) for r in s.index().terms().groupBy("term").agg(F.sum("df").alias("df"), F.sum("times").alias("times")).collect()}
    assert words(store) == words(whole) and store.count_chunks() == whole.count_chunks()


def test_texts_of_plain_words_are_cut_as_others(spark):
    odd = ["", None, "Plain Words 7up src7", "\u0130stanbul \u212aelvin na\u00efve", "getUserName", "a_b _ __", "認証 word", "ABC Abc aB", "A1b2 3c\nD"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, x string").select("i", tk.text_terms(F.col("x")).alias("a"), tk.body_terms(tk.tokens(F.col("x"))).alias("b"))
    assert all(r.a == r.b for r in rows.collect())


def test_snapshots_read_documents_as_they_are(spark):
    """A table joined with itself moves all texts, each time a snapshot is read."""
    from siftline.plans import catalogue

    for df in catalogue._snapshots(spark, "/root/testdata/sf0.001"):
        assert "Join" not in df._jdf.queryExecution().toString()


def test_snapshots_are_compared_once(spark, monkeypatch):
    """What differs between two snapshots is a table; else each step that asks for it hashes all texts again."""
    from siftline.plans import catalogue

    names, staged = [], Store.staged
    monkeypatch.setattr(Store, "staged", lambda self, df, name: names.append(name) or staged(self, df, name))
    monkeypatch.setattr(Store, "update", lambda *_: None)
    catalogue._synced(spark, "/root/testdata/sf0.001")

    def follow_(*_, **__):
        raise StopIteration

    monkeypatch.setattr(catalogue, "follow", follow_)
    with pytest.raises(StopIteration):
        catalogue.q38_followed_index(spark, "/root/testdata/sf0.001")
    assert [x for x in names if x.endswith("-diff")] == ["catalogue-diff", "followed-diff"]


def shuffled(spark):
    """Bytes that all stages so far have written for others."""
    gateway = spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = gateway.jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def shuffle_files(spark):
    every = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in every.mkString("\n").split("\n") if "/shuffle_" in name}


@pytest.mark.parametrize("words", [[""], ["a", "", "認証"], []])
def test_packed_arrays_are_what_they_were(words):
    sizes, letters = ix._letters(ix.pa.array(["before", *words], ix.pa.string()).slice(1))
    numbers = ix.np.array([0, -1, 2**40, 7])
    got = ix._unpacked(ix._pack(numbers, sizes, letters, ix.np.empty(0, ix.np.int32)), (ix.np.int64, ix.np.int32, ix.np.uint8, ix.np.int32))
    assert got[0].tolist() == numbers.tolist() and ix._words(got[1], got[2]).to_pylist() == words and not len(got[3])
    assert [len(x) for x in ix._unpacked(ix._pack(sizes[:0], letters[:0]), (ix.np.int32, ix.np.uint8))] == [0, 0]


def test_a_segment_moves_little_and_leaves_nothing(spark, tmp_path):
    """What is shuffled stays on the disks until all of it has moved: postings move packed, and go when the table is written."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(1000)]
    rows = [(f"d/f{i}.md", 1, 1, " ".join(rng.choices(vocabulary, k=300))) for i in range(1500)]
    files, moved = shuffle_files(spark), shuffled(spark)
    ix.replace(spark.createDataFrame(rows, CHUNK), f"file://{tmp_path}/index")
    assert 0 < shuffled(spark) - moved < 2 * sum(len(r[3]) for r in rows)
    assert not [x for x in shuffle_files(spark) - files if os.path.getsize(x) > 100_000]


@pytest.mark.parametrize("held", [-1, 1 << 18])
def test_masks_go_to_the_chunks(spark, monkeypatch, tmp_path, held):
    """Chunks that are gone are found without moving the others, while masks are few."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(rank, "MANY", 0)
    monkeypatch.setattr(ix, "HELD", held)
    joined, term_counts = [], ix.term_counts
    monkeypatch.setattr(ix, "term_counts", lambda rows: joined.append(rows._jdf.queryExecution().optimizedPlan().toString()) or term_counts(rows))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store, rows = Store(spark, "", f"file://{tmp_path}/a"), {r[0]: r for r in corpus(300, 5)}
        store.update(spark.createDataFrame([*rows.values()], FILES))
        for part in (1, 4):
            store.update(spark.createDataFrame([], FILES), spark.createDataFrame([(p,) for p in list(rows)[part::8]], "filepath string"))
        left = [r for i, r in enumerate(rows.values()) if i % 8 not in (1, 4)]
        whole = Store(spark, "", f"file://{tmp_path}/b")
        whole.update(spark.createDataFrame(left, FILES))
        words = lambda s: {(r.term, r.df, r.times) for r in s.index().terms().groupBy("term").agg(F.sum("df").alias("df"), F.sum("times").alias("times")).collect()}
        assert words(store) == words(whole) and {r.filepath for r in store.files().collect()} == {r[0] for r in left}
        assert len(joined) == 2 and all(("strategy=broadcast" in x) == (held > 0) for x in joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_batch_is_kept_no_longer_than_it_is_taken(spark, monkeypatch, tmp_path):
    """Texts are grouped by file only where a file has several rows, and the batch's tables go when the index has it."""
    made, scratch = [], src.scratch
    monkeypatch.setattr(src, "scratch", lambda spark, name: made.append(scratch(spark, name)) or made[-1])
    store, latest = Store(spark, "", f"file://{tmp_path}/index"), follow.latest
    monkeypatch.setattr(follow, "latest", None)
    rows = [(f"f{i}.md", 1.0, f"text w{i}", False) for i in range(9)]
    assert follow.take(store, spark.createDataFrame([*rows, (None, 2.0, "x", None)], follow.CHANGES), 0)
    monkeypatch.setattr(follow, "latest", latest)
    again = [("f1.md", 2.0, "older", False), ("f1.md", 3.0, "newer", False), ("f2.md", 4.0, None, True), ("f2.md", 4.0, "kept", False), ("f9.md", 1.0, None, None)]
    assert follow.take(store, spark.createDataFrame(again, follow.CHANGES), 1) and follow.take(store, spark.createDataFrame([], follow.CHANGES), 2)
    assert {r.filepath: r.raw_snippet for r in store.chunks().collect()} == {f"f{i}.md": f"text w{i}" for i in range(9) if i not in (1, 2)} | {"f1.md": "newer"}
    assert {r.filepath for r in store.metadata().collect()} == {f"f{i}.md" for i in range(10) if i != 2}
    tables = [x for x in made if "/changes-" in x]
    assert len(tables) == 4 and not any(ix.exists(spark, x) for x in tables)
