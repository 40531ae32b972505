import json
import os
import math
import sqlite3
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from siftline.config import Settings
from siftline.functions import text as tx
from siftline.functions import tokenize as tk
from siftline.operators import post, rank, render
from siftline.operators.chunk import bounds, chunks
from siftline.operators.index import Index
from siftline.serving import adapter, service
from siftline.serving.service import Server
from siftline.sources import files as src
from siftline.streaming.sync import Store

CASES = {
    "getUserProfile": "getuserprofile get user profile", "session_token": "session_token session token", "HTTPServer": "httpserver", "v2API": "v2api",
    "__init__": "__init__ init", "error_404": "error_404 error 404", "404": "", "有効期限": "有効 効期 期限", "有": "有", "café": "caf",
}


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


@pytest.mark.parametrize("text", CASES)
def test_tokens(spark, text):
    assert " ".join(one(spark, tk.tokens(F.col("t")), t=text)) == CASES[text] == " ".join(tk.query_tokens(text))


def test_match_expression():
    assert tk.match_expression("有効期限") == '"有効" OR "効期" OR "期限"'
    with pytest.raises(ValueError):
        tk.match_expression("a", "XOR")


def test_extension_and_lines(spark):
    for path, ok in {"src/main.py": True, "a/.md": False, "x.BLADE.PHP": True, "b.bin": False}.items():
        assert one(spark, tx.matches_extension(F.col("p")), p=path) is ok
        assert src.matches(path) is ok
    for text in ("", "a", "a\n", "a\r\nb\x0bc\n\nd", "\n", "\u2028x"):
        assert one(spark, tx.lines(F.col("t")), t=text) == text.splitlines()


def test_truncation(spark):
    text = "ありがとうございます"
    for n in (0, 1, 5, 10, 30, 99):
        want = text.encode()[:n].decode(errors="ignore")
        assert one(spark, tx.truncated(F.col("t"), n), t=text) == want == render.truncate_bytes(text, n)


@pytest.mark.parametrize(("blank", "snap", "want"), [(None, True, [(1, 80), (61, 140), (121, 150)]), (83, True, [(1, 83), (61, 140), (121, 150)]), (83, False, [(1, 80), (61, 140), (121, 150)])])
def test_chunk_bounds(spark, blank, snap, want):
    rows = "\n".join("" if i == blank else f"line {i}" for i in range(1, 151))
    assert [tuple(x) for x in one(spark, bounds(tx.lines(F.col("t")), snap=snap), t=rows)] == want


def test_chunk_of_nothing(spark):
    assert chunks(spark.createDataFrame([("a", ""), ("b", None)], "filepath string, text string")).count() == 0
    with pytest.raises(ValueError):
        bounds(F.array(), 10, 10)


FILES = [
    ("src/auth.py", "def authenticate_user(name):\n    return session_token(name)"), ("src/user_profile.py", "def run(): pass"), ("src/util.py", "def get_user_profile(): return 1"),
    ("docs/a.md", "session token of the user"), ("docs/b.md", "the profile of getUserProfile and user_profile user_profile"), ("lib/c.js", "const x = sessionToken()"), ("lib/d.js", "nothing at all"),
]


@pytest.fixture(scope="module")
def index(spark):
    return Index.of(chunks(spark.createDataFrame(FILES, "filepath string, text string")))


@pytest.mark.parametrize(("query", "mode"), [("user_profile", "OR"), ("session_token", "OR"), ("user profile", "AND"), ("the the token", "OR"), ("authenticate_user session_token", "OR")])
def test_scores_equal_sqlite(spark, index, query, mode):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(p, b, tokenize='unicode61 remove_diacritics 2')")
    for path, text in FILES:
        db.execute("INSERT INTO f VALUES (?, ?)", (path, " ".join(tk.query_tokens(path) + tk.query_tokens(text))))
    want = dict(db.execute("SELECT p, bm25(f, 3.0, 1.0) FROM f WHERE f MATCH ?", (tk.match_expression(query, mode),)).fetchall())
    got = {r.filepath: r.score for r in rank.search(index, {0: query}, 20, mode, diversify=False).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[p], want[p], rel_tol=1e-9, abs_tol=1e-12) for p in got)


def test_stored_index(spark, index, tmp_path):
    index.write(f"file://{tmp_path}/i")
    stored = Index.open(spark, f"file://{tmp_path}/i")
    find = lambda i: [(r.filepath, round(r.score, 9)) for r in rank.search(i, {0: "session_token user"}, 5).orderBy("rank").collect()]
    assert find(stored) == find(index) != []


def test_bad_queries(index):
    with pytest.raises(ValueError):
        rank.scores(index, {0: "!!!"})
    with pytest.raises(ValueError):
        rank.scores(index, {0: "a"}, "XOR")
    assert rank.search(index, {0: "404"}, 5).count() == 0


def test_thinning(spark):
    rows = [(0, i, f, s, s + 79, "x", -1.0) for i, (f, s) in enumerate([("big", 1), ("big", 31), ("big", 200), ("other", 1)], 1)]
    hits = spark.createDataFrame(rows, "q int, rank int, filepath string, start_line int, end_line int, raw_snippet string, score double")
    assert [(r.filepath, r.start_line) for r in post.thinned(hits, 5).orderBy("rank").collect()] == [("big", 1), ("big", 200), ("other", 1)]
    assert post.thinned(hits, 5, Settings(near_lines=1)).count() == 4


def test_confidence_and_hint():
    hit = lambda s, f=None: {"score": s} | ({} if f is None else {"fusion_score": f})
    assert [render.judge(x)["label"] for x in ([], [hit(-1)], [hit(-10), hit(-2)], [hit(-10), hit(-9)], [hit(-1, 0.03), hit(-5, 0.01)])] == ["none", "single", "dominant", "close_contest", "dominant"]
    assert render.judge([hit(-10), hit(-2)])["score_gap"] == 8.0
    assert render.hint([], 5) is None and render.hint([hit(-10), hit(-8)], 2) is None
    assert render.hint([hit(-10), hit(-9)], 10) and render.hint([hit(-0.5)], 1)


def test_json_stays_json():
    hits = [{"filepath": "a", "start_line": 1, "end_line": 2, "raw_snippet": "x" * 500, "score": -3.0}] * 9
    text = render.render(hits, "json", 2000, "q", 5)
    assert len(text.encode()) <= 2000 and json.loads(text)["count"] == 9


def test_rpc(index):
    server = Server(lambda: index)
    ask = lambda method, **params: json.loads(server.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})))
    assert ask("tools/list")["result"]["tools"][0]["name"] == "search"
    found = ask("tools/call", name="search", arguments={"query": "authenticate_user", "queries": ["session_token"]})["result"]["structuredContent"]
    assert found["results"][0]["filepath"] == "src/auth.py" and set(found["results"][0]["matched_queries"]) == {"authenticate_user", "session_token"}
    assert ask("tools/call", name="search", arguments={"query": "x", "queries": "y"})["error"]["code"] == -32602
    assert ask("nope")["error"]["code"] == -32601 and json.loads(server.handle("{"))["error"]["code"] == -32700
    assert server.handle(json.dumps({"jsonrpc": "2.0", "method": "ping"})) is None
    assert ask("tools/call", name="search", arguments={"query": "zzzqq"})["result"]["structuredContent"]["status"] == "zero_match"
    assert server.list_tools()[0]["name"] == "search" and server.discover()["tools"] and server.call_tool("search", {"query": "profile"})["isError"] is False
    answers = json.loads(server.handle(json.dumps([{"jsonrpc": "2.0", "id": 1, "method": "ping"}, {"jsonrpc": "2.0", "method": "ping"}, 7])))
    assert [a.get("error", {}).get("code") for a in answers] == [None, -32600]
    bad = Server(lambda: 1 / 0)
    assert json.loads(bad.handle(json.dumps({"jsonrpc": "2.0", "id": 2, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "x"}}})))["error"]["code"] == -32603


def test_fusion_arguments(index):
    two = service.find(index, "authenticate_user", ["session_token"], 3, pool_k=1, rrf_k=10)
    assert two[0]["filepath"] == "src/auth.py" and two[0]["fusion_score"] == pytest.approx(2 / 11) and len(two) == 1
    assert "fusion_score" not in service.find(index, " profile ", ["profile", " "])[0] and service.find(index, " ") == []


def test_function_calls(index):
    assert adapter.call({"name": "f", "arguments": {}}, index)["isError"]
    assert "auth.py" in adapter.call({"name": "f", "arguments": '{"query": "authenticate"}'}, index)["content"][0]["text"]
    assert json.loads(adapter.call({"query": "authenticate", "format": "json"}, index)["content"][0]["text"])["status"] == "ok"
    assert adapter.arguments("{") == {"query": "", "top_k": 5, "format": "markdown", "max_bytes": 4000, "mode": "OR"}
    assert adapter.arguments({"query": 7, "top_k": "3", "mode": "XOR", "max_bytes": -1, "format": "json"}) == {"query": "7", "top_k": 3, "format": "json", "max_bytes": 4000, "mode": "OR"}
    assert adapter.arguments(adapter.envelope("a b", top_k=9)) == {"query": "a b", "top_k": 9, "format": "markdown", "max_bytes": 4000, "mode": "OR"}
    assert adapter.schema()["parameters"]["required"] == ["query"]
    line = adapter.argv("x; rm -rf y", db="/i", mode="AND")
    assert line[-1] == "x; rm -rf y" and line[line.index("--mode") + 1] == "AND" and line[line.index("--db") + 1] == "/i"
    assert adapter.run(["/no/such/program"])["returncode"] == 127 and adapter.run([sys.executable, "-c", "import time; time.sleep(9)"], 0.2)["returncode"] == 124
    assert adapter.run([sys.executable, "-c", "print('é'); exit(3)"]) | {"command": 0} == {"command": 0, "returncode": 3, "stdout": "é\n", "stderr": "", "error": None}
    assert adapter.result("{", "json")["isError"] and not adapter.result("# x", "markdown")["isError"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.py").write_text("def authenticate(): pass")
    assert service.places(".", str(tmp_path / "i")) == (str(tmp_path), f"file://{tmp_path}/i")
    assert service.places(str(tmp_path), None) == (str(tmp_path), f"file://{tmp_path}/.siftline")
    assert service.main(["authenticate", "--db", str(tmp_path / "i"), "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["results"][0]["filepath"] == "a.py"
    (tmp_path / "b.py").write_text("other words")
    assert service.main(["other", "--root", str(tmp_path), "--db", str(tmp_path / "i"), "--no-auto-sync"]) == 0
    assert json.loads(capsys.readouterr().out)["status"] == "zero_match"
    store = Store(spark, str(tmp_path), f"file://{tmp_path}/i")
    store.sync = lambda: 1 / 0
    assert service.current(store)().n_chunks == 1 and "sync failed" in capsys.readouterr().err  # what is stored is searched


def test_markdown_as_it_is():
    hits = [{"filepath": "a.py", "start_line": 1, "end_line": 2, "raw_snippet": "x\ny", "score": -6.0}, {"filepath": "b.py", "start_line": 3, "end_line": 3, "raw_snippet": "z", "score": -3.0}]
    want = "# BM25 Search Results\n\n**Query:** `q`\n\n**Confidence:** dominant (top: -6.000000, runner-up: -3.000000, gap: 3.000000)\n\n## 1. a.py (lines 1-2)\nscore: -6.000000\n\n```\nx\ny\n```\n\n## 2. b.py (lines 3-3)\nscore: -3.000000\n\n```\nz\n```\n"
    assert render.render(hits, "markdown", None, "q", 5) == want and render.render(hits, "other", 30, "q", 5) == want[:30]


def test_sync(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    (root / "a.py").write_text("alpha beta")
    (root / "b.py").write_text("gamma")
    (root / "c.bin").write_text("alpha")
    store = Store(spark, str(root), f"file://{tmp_path}/index")
    assert store.sync()["full_build"] and {r.filepath for r in store.files().collect()} == {"a.py", "b.py"}
    (root / "a.py").write_text("delta")
    (root / "b.py").unlink()
    (root / "d.md").write_text("epsilon")
    report = store.sync()
    assert (report["updated"], report["deleted"]) == (2, 1)
    assert [r.filepath for r in rank.search(store.index(), {0: "delta"}, 5).collect()] == ["a.py"]
    assert rank.search(store.index(), {0: "alpha gamma"}, 5).count() == 0
    assert store.copy_to(f"file://{tmp_path}/copy") and not store.copy_to(f"file://{tmp_path}/copy")
    assert store.sync()["updated"] == 0


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.org", *args], check=True, capture_output=True)


def test_sync_of_a_git_repo(spark, tmp_path):
    root = tmp_path / "c++ [x]"
    (root / "app").mkdir(parents=True)
    git(root, "init", "-q")
    for name, text in {"app/[id].tsx": "alpha page", "b c.py": "beta", "été.md": "gamma", ".gitignore": "*.log.md\n", "x.log.md": "ignored", "empty.py": ""}.items():
        (root / name).write_text(text)
    git(root, "add", ".")
    git(root, "commit", "-qm", "one")
    store = Store(spark, str(root), f"file://{tmp_path}/index")
    first = store.sync()
    assert first["full_build"] and first["files"] == 4 and first["chunks"] == 3 and first["head"] == src.head_commit(str(root))
    assert {r.filepath for r in store.files().collect()} == {"app/[id].tsx", "b c.py", "été.md"}
    assert src.is_git_repo(str(root)) and not src.is_git_repo(str(tmp_path)) and src.head_commit(str(tmp_path)) is None
    again = store.sync()
    assert (again["updated"], again["deleted"]) == (0, 0)
    generation = store.manifest().generation
    assert store.sync()["files"] == 4 and store.manifest().generation == generation
    old = os.stat(root / "b c.py")
    (root / "b c.py").write_text("zeta")
    git(root, "mv", "été.md", "summer.md")
    git(root, "commit", "-qam", "two")
    os.utime(root / "b c.py", ns=(old.st_atime_ns, old.st_mtime_ns))  # only git tells
    second = store.sync()
    assert second["branch_switched"] and second["updated_files"] == ["b c.py", "summer.md"] and second["deleted_files"] == ["été.md"]
    find = lambda q: [r.filepath for r in store.search(q).collect()]
    assert find("zeta") == ["b c.py"] and find("beta") == [] and find("gamma") == ["summer.md"] and find("alpha") == ["app/[id].tsx"]
    changed = {(r.filepath, r.action) for r in src.git_changes(spark, str(root), first["head"]).collect()}
    assert changed == {("b c.py", "changed"), ("été.md", "deleted"), ("summer.md", "changed")}
    # scores are those of an index built anew
    fresh = Store(spark, str(root), f"file://{tmp_path}/fresh")
    fresh.build()
    score = lambda s: [(r.filepath, round(r.score, 12)) for r in s.search("zeta gamma alpha page").orderBy("rank").collect()]
    assert score(store) == score(fresh) and store.count_chunks() == fresh.count_chunks() == 3


def test_store_changes_one_by_one(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    (root / "a.py").write_text("alpha")
    with Store(spark, str(root), f"file://{tmp_path}/i") as store:
        assert store.count_chunks() == 0 and store.get_state("k") is None and store.get_metadata("a.py") is None
        assert store.insert_chunk("m.py", 1, 2, "mu nu") == "m.py#000000001"
        store.set_state("k", "v")
        store.upsert_metadata("m.py", 5.5, "abc")
        store.upsert_metadata("m.py", 6.5, "abd")
        assert store.get_state("k") == "v" and store.get_metadata("m.py") == (6.5, "abd") and store.count_chunks("m.py") == 1
        assert store.index_file("a.py") == 1 and store.index_file("gone.py") == 0 and store.count_chunks() == 2
        assert [r.filepath for r in store.search("alpha nu").orderBy("rank").collect()] == ["a.py", "m.py"]
        assert store.delete_chunks("m.py") == 1 and store.get_metadata("m.py") and store.delete_file("m.py") == 0 and store.get_metadata("m.py") is None
        assert store.search("nu").count() == 0 and store.count_chunks() == 1 and len(store.tables()) >= 3
        for i in range(10):  # segments are merged
            (root / "a.py").write_text(f"alpha v{i}")
            store.index_file("a.py")
        assert len(store.manifest().segments) <= 8 and store.count_chunks() == 1 and [r.raw_snippet for r in store.search("alpha").collect()] == ["alpha v9"]
        names = os.listdir(tmp_path / "i")
        assert sum(n.startswith("manifest-") for n in names) == 2 and sum(n.startswith("segment-") for n in names) <= 12
        late = store.manifest()
        late.generation -= 1
        with pytest.raises(RuntimeError):  # a writer that comes second
            late.publish(spark, store.folder)
    target = tmp_path / "t"
    target.mkdir()
    (target / "a.py").write_text("alpha v9")
    (target / "b.py").write_text("other")
    warm = Store(spark, str(target), f"file://{tmp_path}/j")
    report = warm.warm_start_from(store.folder)
    assert report["copied"] and "b.py" in report["updated_files"] and {r.filepath for r in warm.files().collect()} == {"a.py", "b.py"}
    assert not warm.warm_start_from(f"file://{tmp_path}/nothing", sync=False)["copied"]


def test_undecodable_text(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"ok \xff\xfe caf\xc3\xa9 \xe2\x82")
    row = src.read_files(spark, str(tmp_path)).first()
    assert row.text == b"ok \xff\xfe caf\xc3\xa9 \xe2\x82".decode(errors="replace") and row.filepath == "a.md"


def test_terms_cut_together_are_those_cut_one_by_one(spark):
    texts = ["", " ", "plain words only", "getUserName and user_name", "_x __ a_ _", "HTTPServer2Go x", "認証設定a期限 b", "漢", "漢 字", "x\ny_z\n\nABC", "İK straße É", "a1b2 3c 44", "wordаword", "getUser", "a_b c_d e", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in d.select("t", tk.text_terms(F.col("t")).alias("a"), tk.body_terms(tk.tokens(F.col("t"))).alias("b")).collect():
        assert r.a == r.b, r.t


def test_bounds_of_a_long_file_take_time_by_its_lines(spark):
    n = 20000
    d = spark.createDataFrame([("x\n" * n,)], "text string").select(tx.lines(F.col("text")).alias("ls"))
    begun = time.monotonic()
    got = d.select(F.explode(bounds(F.col("ls"), 10, 3)).alias("c")).select("c.*").collect()
    assert time.monotonic() - begun < 20
    assert [r[:] for r in got] == [(s + 1, min(s + 10, n)) for s in range(0, n, 7) if s == 0 or s + 3 < n]
