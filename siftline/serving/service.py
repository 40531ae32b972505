"""Searches as a service: one engine behind a command line, JSON-RPC lines and function calls."""

from __future__ import annotations

import argparse
import dataclasses
import json
import os
import sys
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from siftline.config import DEFAULT
from siftline.operators import post, rank
from siftline.operators.index import Index
from siftline.operators.render import envelope, render, zero_match
from siftline.streaming.sync import Store

# The tool's schema, the protocol's names and codes.
TOOL = {
    "name": "search",
    "description": "Ranked keyword search over the indexed files.",
    "inputSchema": {
        "type": "object",
        "properties": {
            "query": {"type": "string"}, "queries": {"type": "array", "items": {"type": "string"}, "maxItems": 5},
            "top_k": {"type": "integer", "minimum": 1, "maximum": 100, "default": 5}, "mode": {"type": "string", "enum": ["OR", "AND"], "default": "OR"},
        },
        "required": ["query"],
    },
}
PROTOCOL = "2026-07-28"


def find(index: Index, query: str, queries: list[str] | None = None, top_k: int = 5, mode: str = "OR", pool_k: int | None = None, rrf_k: int = DEFAULT.rrf_k) -> list[dict]:
    """The hits of one query, or of several fused: the best ``pool_k`` of each (by default a pool for ``top_k``)."""
    texts = list(dict.fromkeys(t for q in [query, *(queries or [])] if (t := q.strip())))
    if not texts:
        return []
    numbered = dict(enumerate(texts))
    if len(texts) == 1:
        rows = rank.search(index, numbered, top_k, mode).orderBy("rank").collect()
        return [{k: r[k] for k in ("filepath", "start_line", "end_line", "raw_snippet", "score")} for r in rows]
    hits = rank.search(index, numbered, pool_k or DEFAULT.pool(top_k), mode)
    fused = post.fused(hits, numbered, top_k, dataclasses.replace(DEFAULT, rrf_k=rrf_k)).orderBy("rank")
    return [{k: v for k, v in r.asDict().items() if k != "rank"} for r in fused.collect()]


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code, self.message = code, message


def arguments(raw: object) -> dict:
    if not isinstance(raw, dict):
        raise RpcError(-32602, "arguments must be an object")
    query, queries, top_k, mode = raw.get("query"), raw.get("queries"), raw.get("top_k", 5), raw.get("mode", "OR")
    if not isinstance(query, str) or not query.strip():
        raise RpcError(-32602, "query must be a string that isn't empty")
    if queries is not None and not (isinstance(queries, list) and len(queries) <= 5 and all(isinstance(q, str) for q in queries)):
        raise RpcError(-32602, "queries must be up to five strings")
    if isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= 100:
        raise RpcError(-32602, "top_k must be a whole number from 1 to 100")
    if mode not in ("OR", "AND"):
        raise RpcError(-32602, "mode must be OR or AND")
    return {"query": query, "queries": queries, "top_k": top_k, "mode": mode}


class Server:
    """JSON-RPC: ``index`` gives the index to search, after a sync where that is wanted; ``other`` opens one that a call names."""

    def __init__(self, index: Callable[[], Index], other: Callable[[str], Index] | None = None):
        self.index, self.other = index, other

    def discover(self) -> dict:
        return self.dispatch("server/discover", {})

    def list_tools(self) -> list[dict]:
        return self.dispatch("tools/list", {})["tools"]

    def call_tool(self, name: str, raw: object) -> dict:
        return self.dispatch("tools/call", {"name": name, "arguments": raw})

    def call(self, raw: object) -> dict:
        args = arguments(raw)
        named = raw.get("db_path") if self.other else None
        hits = find(self.other(str(named)) if named else self.index(), **args)
        body = envelope(hits, args["query"], args["top_k"]) if hits else zero_match(args["query"])
        if args["queries"]:
            body["queries_used"] = list(dict.fromkeys([args["query"], *args["queries"]]))
        return {"resultType": "complete", "content": [{"type": "text", "text": json.dumps(body, ensure_ascii=False)}], "structuredContent": body, "isError": False}

    def dispatch(self, method: str, params: dict) -> dict:
        if method == "initialize":
            return {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "siftline", "version": "0.1"}}
        if method == "ping" or method in ("notifications/initialized", "initialized"):
            return {}
        if method == "server/discover":
            return {"protocolVersions": [PROTOCOL], "capabilities": {"tools": {}}, "tools": [TOOL]}
        if method == "tools/list":
            return {"tools": [TOOL]}
        if method == "tools/call":
            if params.get("name") != TOOL["name"]:
                raise RpcError(-32602, f"no tool {params.get('name')!r}")
            return self.call(params.get("arguments", {}))
        raise RpcError(-32601, f"no method {method!r}")

    def _one(self, message: object) -> dict | None:
        if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
            return {"jsonrpc": "2.0", "id": message.get("id") if isinstance(message, dict) else None, "error": {"code": -32600, "message": "invalid request"}}
        try:
            answer = {"result": self.dispatch(message["method"], message.get("params") or {})}
        except RpcError as e:
            answer = {"error": {"code": e.code, "message": e.message}}
        except Exception as e:  # noqa: BLE001
            answer = {"error": {"code": -32603, "message": str(e)}}
        return {"jsonrpc": "2.0", "id": message["id"]} | answer if "id" in message else None

    def handle(self, line: str) -> str | None:
        try:
            message = json.loads(line)
        except ValueError:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}})
        if isinstance(message, list) and message:
            answers = [a for m in message if (a := self._one(m)) is not None]
            return json.dumps(answers, ensure_ascii=False) if answers else None
        answer = self._one(message)
        return None if answer is None else json.dumps(answer, ensure_ascii=False)

    def serve(self, lines: Iterable[str], out) -> None:
        for line in lines:
            if line.strip() and (answer := self.handle(line)) is not None:
                print(answer, file=out, flush=True)


def current(store: Store, auto_sync: bool = True) -> Callable[[], Index]:
    """Gives the store's index, synced first; a sync that fails is told on standard error and what is stored is searched."""

    def index() -> Index:
        if auto_sync:
            try:
                store.sync()
            except Exception as e:  # noqa: BLE001
                print(f"sync failed: {e}", file=sys.stderr)
        return store.index()

    return index


def places(root: str, db: str | None) -> tuple[str, str]:
    """The tree and the index folder that the options mean: a folder without a tree stands in its tree."""
    if db and root == "." and os.path.isdir(parent := os.path.dirname(os.path.abspath(db))):
        root = parent
    if "://" in root:
        return root, f"file://{os.path.abspath(db)}" if db and "://" not in db else db or f"{root.rstrip('/')}/.siftline"
    root = os.path.abspath(root)
    return root, f"file://{os.path.abspath(db)}" if db and "://" not in db else db or f"file://{root}/.siftline"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="siftline")
    p.add_argument("query", nargs="?")
    p.add_argument("--queries", nargs="*")
    p.add_argument("--top-k", type=int, default=5)
    p.add_argument("--format", choices=["markdown", "json"], default="markdown")
    p.add_argument("--max-bytes", type=int, default=4000)
    p.add_argument("--mode", choices=["OR", "AND"], default="OR")
    p.add_argument("--root", "-r", default=".")
    p.add_argument("--db")
    p.add_argument("--no-auto-sync", action="store_true")
    p.add_argument("--stdio", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("siftline").getOrCreate()
    root, folder = places(a.root, a.db)
    index = current(Store(spark, root, folder), not a.no_auto_sync)
    if a.stdio or a.query is None:
        Server(index, lambda db: Index.open(spark, places(".", db)[1])).serve(sys.stdin, sys.stdout)
        return 0
    hits = find(index(), a.query, a.queries, a.top_k, a.mode)
    print(render(hits, a.format, a.max_bytes, a.query, a.top_k) if hits else json.dumps(zero_match(a.query)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
