import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import decontaminate, line_dedup, mixing

from test_operators import brute_components, lines_by_definition, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    shared = [words(rng.randint(3, 9), 900 + i) for i in range(6)]
    texts, toxic = {}, set()
    for i in range(360):
        lines = [words(rng.randint(4, 14), 5000 + 10 * i + j) for j in range(rng.randint(2, 6))]
        if i % 6 == 0:
            toxic.add(i)
            lines.insert(1, " ".join(rng.choice(["zorgux you", "zorgat idiot", "you zorgux scum"]) for _ in range(4)))
        texts[i] = "\n".join(lines)
    for i in range(360, 420):  # copies, near copies and shared lines
        base = texts[rng.choice([x for x in range(360) if x not in toxic])]
        w = base.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts[i] = rng.choice([base, " ".join(w), "\n".join([words(9, 9000 + i), rng.choice(shared), rng.choice(shared), words(8, 9500 + i)])])
    items = [(k, words(30, 7000 + k)) for k in range(5)]
    for i in range(420, 430):
        texts[i] = f"{words(20, 8000 + i)}\n{items[i % 5][1]} {words(20, 8100 + i)}"
    docs = [(i, t, "en", rng.choice(["a", "b", "c", None]), len(t)) for i, t in texts.items()]
    docs += [(500, None, None, None, None), (501, "", "en", "a", 0), (None, "no id here", "en", "a", 10), (502, " \n ", "en", "b", 3), (503, words(3000, 6000), "en", "c", 1), (503, words(3000, 6000), "en", "c", 1)]
    labels = [(i, 1, int(i in toxic)) for i in range(300)] + [(None, 1, 1), (500, None, None)]
    return tables(spark, tmp_path_factory.mktemp("corpus"), docs, labels, [*items, (9, None), (None, "x y z")]), toxic, items


def test_stages_against_brute_force(spark, corpus):
    folder, toxic, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, columns = docs.collect(), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        docs = spark.createDataFrame(out.collect(), out.schema)
        after = docs.collect()
        ids, text = [r.doc_id for r in after], {r.doc_id: r.text for r in after} if name != "mixing" else {}
        if name != "mixing":
            assert docs.columns == columns
        if name == "toxicity":
            gone = {r.doc_id for r in before} - {*ids}
            assert len(gone & toxic) >= 0.95 * len(toxic) and len(gone - toxic) <= 4 and {None, 500, 501} <= {*ids}
        elif name == "line_dedup":
            rows = {r.doc_id: r.text.split("\n") for r in before if r.doc_id is not None and r.text}
            judged = lines_by_definition(rows, line_dedup.MIN_BLOCK_CHARS)
            for i, b in rows.items():
                kept, lost = ("", True) if b in [a for j, a in rows.items() if j < i] else judged[i]
                assert text.get(i) == (None if lost and not kept.strip(" ") else kept), i
        elif name == "near_duplicates":
            component, _ = brute_components([(r.doc_id, r.text) for r in before if r.doc_id is not None], 5, 80)
            assert {i for i in ids if i is not None} == {i for i in component if component[i] == i} and None in ids
        elif name == "decontamination":
            leaked = {r.doc_id for r in before if any(f" {t} " in f" {' '.join((r.text or '').split())} " for _, t in items)}
            assert leaked and {r.doc_id for r in before} - {*ids} == leaked
        else:
            assert docs.columns == ["doc_id", "source", "size", "source_size", "target", "taken"] and len(after) == len(before)
            for source in {r.source for r in after}:
                own = [r for r in after if r.source == source]
                assert abs(sum(r.taken for r in own) - own[0].target) <= mixing.BLOCK + 1 and own[0].source_size == sum(r.size for r in own)
        before = after


def test_run_is_its_stages(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, docs.collect()))


def test_empty_and_clashing(spark, tmp_path, corpus):
    empty = tables(spark, tmp_path / "e", [], [], [])
    assert corpus_pipeline.run(spark, empty).count() == 0
    folder, _, _ = corpus
    more = spark.read.parquet(f"{folder}/documents.parquet").limit(40).withColumns({c: F.lit("x") for c in ("key", "rep", "th", "z", "n_removed", "score", "component", "leaked_items", "best_share", "hit", "cid")})
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, more, folder)
        kept = [c for c in more.columns if c != "n_removed"]
        assert [c for c in out.columns if c != "n_removed"] == kept
        out.collect()


def test_leaks_over_blocks_of_items(spark, corpus, monkeypatch):
    folder, _, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id >= 415")
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    whole = sorted(map(str, decontaminate.leaks(docs, benchmark).select("doc_id", "leaked_items").collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert len(decontaminate.blocks(benchmark)) > 1
    assert sorted(map(str, decontaminate.leaks(docs, benchmark).select("doc_id", "leaked_items").collect())) == whole
