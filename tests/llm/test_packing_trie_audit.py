import hashlib
import random
import zlib
from collections import defaultdict
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siftline.llm import _common, filter_audit, packing, prefix_trie

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, piece string, part string, key string, n string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# packing


def check_packing(rows, texts, capacity):
    """All pieces are there, by the library's own ids; sequences are gapless and none too long."""
    library = Tokenizer.from_file(PATH)
    want = []
    for doc, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) % capacity or capacity
        for piece, start in enumerate([0, *range(head, len(ids), capacity)]):
            part = ids[start : start + (capacity if piece else head)]
            want.append((doc, piece, start, len(part), zlib.crc32(part.tobytes())))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in rows)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r.length for r in rows)


TEXTS = [
    None, "", " ", "a", "  two  spaces \n\n and\tmore ", "it's we'll <|endoftext|> x<|endoftext|>", "été 12345 日本語のテキスト", "x" * 5000, " " * 4000 + "b", "=" * 3000 + " end",
    "a\x1cb c d e᠎f  g", "word " * 90000, "".join(random.Random(3).choice("ab c\n.é'") for _ in range(700000)),
]


@pytest.mark.parametrize("capacity", [1024, 16])
def test_packing_by_definition(spark, capacity):
    texts = [*enumerate(TEXTS), (None, "no id"), (7, "again"), (7, "again")] + [(100 + i, "tok " * (i % 37)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "en", "s", "x", "y", "z", "n") for i, t in texts], DOCS).repartition(7)
    packed = packing.packed(docs, PATH, capacity, open_bins=8)
    rows = packed.collect()
    n, total = check_packing(rows, texts, capacity)
    assert n <= 1.05 * total / capacity + 3
    assert rows_of(packed) == sorted(map(tuple, rows), key=repr)
    assert packing.packed(docs.limit(0), PATH).count() == 0


def test_packing_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    n, total = check_packing(packing.op11_best_fit(spark, SF).collect(), [tuple(r) for r in docs.collect()], 1024)
    assert n <= 1.02 * total / 1024 + 1


def test_bins_by_definition():
    rng = random.Random(5)
    bins, open_ = packing.Bins(0, 64, 5), {}
    for _ in range(3000):
        size = rng.choice([rng.randint(1, 64), rng.randint(1, 20)])
        bin_, place = bins.put(size)
        fits = [f for f in open_.values() if f >= size]
        if fits:  # the least free space that holds it
            assert open_[bin_] == min(fits) and place == 64 - min(fits)
        else:
            assert place == 0 and bin_ not in open_
        left = open_.pop(bin_, 64) - size
        if left:
            if len(open_) == 5:
                full = min(open_.values())
                open_.pop(next(b for b, f in open_.items() if f == full and b not in bins.open()))
            open_[bin_] = left
        assert sorted(open_) == sorted(bins.open()) and len(open_) <= 5


def test_stretches_keep_ids():
    rng = random.Random(8)
    library = Tokenizer.from_file(PATH)
    for _ in range(60):
        text = "".join(rng.choice(["a", " ", "  ", "\n", "Bc", "'s", "9", "é", " ", "\x1c", ".", "<|endoftext|>"]) for _ in range(400))
        parts = list(packing.stretches(text, 20))
        assert "".join(parts) == text and len(parts) > 3
        assert [i for p in parts for i in library.encode(p, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids
        assert packing.ids(PATH, text)[:-1].tolist() == library.encode(text, add_special_tokens=False).ids


# the trie

CHATS = "conv_id long, turn long, role string, text string, depth string, key string, part string, n string"


def trie_by_definition(turns):
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []

    def walk(node):
        leaves, saved = (0 if children[node] else 1), (len(members[node]) - 1) * (len(words(node[-1][1])) if node else 0)
        for x in children[node]:
            a, b = walk(x)
            leaves, saved = leaves + a, saved + b
        ends = ",".join(str(c) for c in sorted(members[node]) if built[c] == node)
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        walk(())
    return sorted(out, key=repr)


def words(text):
    return [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]


def chats(seed, n=120, long=0):
    rng = random.Random(seed)
    rows = []
    for c in [*rng.sample(range(0, 400), n)]:
        for t in range(rng.choice([1, 1, 2, 3, 5])):
            rows.append((c, rng.choice([t, t, None]) if rng.random() < 0.1 else t, rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else "user", rng.choice(["a b", "a  b c", "", None, "x"])))
    rows += [(None, 0, "user", "nobody"), (401, 0, None, None), rows[0], rows[0]]
    rows += [(777, t, "user", f"turn {t % 7}") for t in range(long)] + [(778, t, "user", f"turn {t % 7}") for t in range(long // 2)]
    return rows


@pytest.mark.parametrize("seed,long,small", [(1, 0, False), (2, 200, True), (3, 60, True)])
def test_trie_by_definition(spark, monkeypatch, seed, long, small):
    if small:  # stretches, hot keys and merges of many tasks in small data
        for module, name, value in [(prefix_trie, "STRETCH", 16), (_common, "SPLIT_ROWS", 10), (prefix_trie, "FAN_IN", 2), (prefix_trie, "PIECE", 3)]:
            monkeypatch.setattr(module, name, value)
    rows = chats(seed, long=long)
    turns = spark.createDataFrame([(*r, "d", "k", "p", "n") for r in rows], CHATS).repartition(5)
    assert rows_of(prefix_trie.trie(turns)) == trie_by_definition(rows)


def test_trie_of_copies_and_nothing(spark):
    rows = [(c, t, "user", "same words") for c in range(0, 3000, 2) for t in range(2)]
    turns = spark.createDataFrame([(*r, "d", "k", "p", "n") for r in rows], CHATS)
    assert rows_of(prefix_trie.trie(turns)) == trie_by_definition(rows)
    assert prefix_trie.trie(turns.limit(0)).count() == 0
    alone = [(21, 0, "user", "one turn")]  # its family has no first conversation, so nothing may be left of it
    assert rows_of(prefix_trie.trie(spark.createDataFrame([(*r, "d", "k", "p", "n") for r in alone], CHATS))) == trie_by_definition(alone)


def equals_sql(spark, query, sql, **tables):
    db = duckdb.connect()
    for name, df in tables.items():
        db.register(name, df.toArrow())
    got = query.toArrow()
    want = db.sql(sql).arrow().read_all().select(got.column_names)
    assert sorted(map(repr, zip(*got.to_pydict().values(), strict=True))) == sorted(map(repr, zip(*want.to_pydict().values(), strict=True)))


def test_trie_equals_sql(spark):
    turns = spark.createDataFrame([(*r, "d", "k", "p", "n") for r in chats(9)], CHATS)
    equals_sql(spark, prefix_trie.trie(turns), prefix_trie.OP12_SQL, conversations=turns)
    equals_sql(spark, prefix_trie.op12_prefix_trie(spark, SF), prefix_trie.OP12_SQL, conversations=spark.read.parquet(f"{SF}/conversations.parquet"))


# the audit


def audit_by_definition(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    judged = defaultdict(list)
    for d, text, lang in docs:
        t = text or ""
        w = words(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": d is not None and least[t] < d,
        }
        judged[lang or ""].append((frozenset(f for f, x in fails.items() if x), d in good, d in toxic))
    out = []
    for part, rows in judged.items():
        removed_in_all = defaultdict(int)
        steps = []
        for order in permutations("ABCDE"):
            for i, f in enumerate(order):
                before = set(order[:i])
                here = [r for r in rows if f in r[0] and not r[0] & before]
                removed_in_all[f] += len(here)
                kept = sum(not r[0] & {*before, f} for r in rows)
                redundant = sum(f in r[0] and bool(r[0] & before) for r in rows)
                steps.append(("".join(order), i + 1, f, kept, len(here), redundant, sum(r[0] == {f} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here)))
        out += [(part, o, s, *counts, removed_in_all[f]) for o, s, f, *counts in steps]
    return sorted(out, key=repr)


def test_audit_by_definition(spark):
    rng = random.Random(6)
    pool = [" ".join(rng.choice(["a", "b", "Cd", "e#", "ff", "ég", f"w{rng.randint(0, 300)}"]) for _ in range(rng.choice([3, 150, 199, 200, 201, 260]))) for _ in range(40)]
    pool += [None, "", " \n\t", "ABC" * 90, "|", "word " * 200, " ".join(f"u{i}" for i in range(250)), " ".join(f"u{i}" for i in range(40000))]
    docs = [(rng.choice([i, i, i, None]) if rng.random() < 0.2 else i, rng.choice(pool), rng.choice(["en", "de", "fr", "", None])) for i in range(400)]
    docs += [docs[3], docs[3], (3, "other text", "en"), (3, docs[3][1], "xx"), (-5, docs[7][1], None)]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d, _, _ in docs if rng.random() < 0.6] + [(None, 1, 1), (3, 0, 0), (3, 1, 0)]
    frame = spark.createDataFrame([(d, t, g, "s", "x", "y", "z", "n") for d, t, g in docs], DOCS).repartition(4)
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(frame, marked)
    assert rows_of(got) == audit_by_definition(docs, labels)
    equals_sql(spark, got, filter_audit.OP13_SQL, documents=frame, labels=marked)
    assert filter_audit.audit(frame.limit(0), marked).count() == 0
    none = filter_audit.audit(frame, marked.limit(0))
    assert rows_of(none) == audit_by_definition(docs, [])


def test_parities_are_inverted(spark):
    rng = random.Random(2)
    rows = [(rng.choice("pq"), rng.randint(0, 3), rng.randint(0, 31), rng.randint(1, 1 << 40)) for _ in range(300)]
    found = {r.part: r for r in filter_audit.cells(filter_audit.parities(spark.createDataFrame(rows, "part string, label int, mask int, n long"))).collect()}
    for part, r in found.items():
        for mask in range(32):
            own = [(label, n) for p, label, m, n in rows if p == part and m == mask]
            assert r.every[mask] == sum(n for _, n in own) and r.good[mask] == sum(n for x, n in own if x & 1) and r.toxic[mask] == sum(n for x, n in own if x & 2)
