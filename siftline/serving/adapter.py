"""Function calls: their schema, their arguments put right, and answers. Nothing here raises but ``Resident``.

A call is answered on an index in this process, or on a folder by a resident service: a process with its own Spark
session that stays between calls and speaks JSON-RPC lines, so that only the first call waits for a start. ``run`` and
``argv`` are for single command lines.
"""

from __future__ import annotations

import json
import queue
import subprocess
import sys
import threading
import time
from collections.abc import Callable
from functools import lru_cache

from siftline.config import DEFAULT
from siftline.operators.index import Index
from siftline.operators.render import render, zero_match

from .service import TOOL, find

# The call's name, its arguments' kinds and defaults, and what outcomes are called.
NAME = "bm25_search"
DEFAULTS = {"top_k": DEFAULT.top_k, "format": "markdown", "max_bytes": DEFAULT.max_bytes, "mode": "OR"}
CHOICES = {"format": ("markdown", "json"), "mode": ("OR", "AND")}
TIMEOUT = 30.0
OUTCOMES = {FileNotFoundError: (127, "launch_failed"), subprocess.TimeoutExpired: (124, "timeout"), OSError: (1, "os_error")}


def schema() -> dict:
    """The function as callers declare it."""
    number = lambda name, **more: {"type": "integer", "default": DEFAULTS[name], "minimum": 1, **more}
    choice = lambda name: {"type": "string", "enum": list(CHOICES[name]), "default": DEFAULTS[name]}
    properties = {"query": {"type": "string"}, "top_k": number("top_k", maximum=100), "format": choice("format"), "max_bytes": number("max_bytes"), "mode": choice("mode")}
    return {"name": NAME, "title": "BM25 Code Search", "description": TOOL["description"], "parameters": {"type": "object", "properties": properties, "required": ["query"]}}


# Arguments: a reader for each field, so that what is missing or wrong gets its default


def _whole(default: int) -> Callable[[object], int]:
    def read(value: object) -> int:
        text = "" if isinstance(value, bool) else str(value).strip()
        return int(text) if text.isascii() and text.isdigit() and int(text) else default

    return read


FIELDS: dict[str, Callable[[object], object]] = {"query": lambda v: "" if v is None else str(v)} | {
    name: (lambda v, name=name: v if isinstance(v, str) and v in CHOICES[name] else DEFAULTS[name]) if name in CHOICES else _whole(DEFAULTS[name]) for name in DEFAULTS
}


def _object(value: object) -> dict:
    """An object, as it is or as JSON text; anything else has no fields."""
    if isinstance(value, str):
        try:
            return _object(json.loads(value) or {}) if value else {}
        except ValueError:
            return {}
    return value if isinstance(value, dict) else {}


def arguments(call: object) -> dict:
    """The search arguments of a call: those of an envelope, or bare ones."""
    given = _object(call)
    if {"name", "arguments"} & given.keys():
        given = _object(given.get("arguments"))
    return {name: read(given.get(name)) for name, read in FIELDS.items()}


def envelope(query: str, **options: object) -> dict:
    """The call that has these arguments."""
    return {"name": NAME, "arguments": {"query": query} | DEFAULTS | options}


# Command lines


def argv(query: str, db: str | None = None, **options: object) -> list[str]:
    """The command line of a search; a list, so that nothing in the query is read by a shell."""
    o = DEFAULTS | options
    given = [x for name in DEFAULTS for x in (f"--{name.replace('_', '-')}", str(o[name]))]
    return [sys.executable, "-m", "siftline.serving.service", *given, *(["--db", db] if db else []), "--", query]


def run(command: list[str], timeout: float | None = TIMEOUT) -> dict:
    """The command's outcome: return code, output, and an error if it didn't run to its end."""
    texts, code, error = ["", ""], None, None
    try:
        with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as child:
            try:
                found = child.communicate(timeout=timeout)
            except subprocess.TimeoutExpired:
                child.kill()
                found = child.communicate()
                raise
            finally:
                texts = [x.decode(errors="replace") for x in found]
            code = child.returncode
    except tuple(OUTCOMES) as e:
        code, what = next(OUTCOMES[kind] for kind in OUTCOMES if isinstance(e, kind))
        error = f"{what}: {e}"
    return {"command": command, "returncode": code, "stdout": texts[0], "stderr": texts[1], "error": error}


class Resident:
    """A service of one index folder that answers call after call."""

    def __init__(self, db: str | None, sync: bool = True):
        line = [sys.executable, "-m", "siftline.serving.service", "--stdio", *(["--db", db] if db else []), *([] if sync else ["--no-auto-sync"])]
        self.process = subprocess.Popen(line, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True)
        self.answers: queue.Queue[str | None] = queue.Queue()
        self.number, self.lock = 0, threading.Lock()
        threading.Thread(target=self._listen, daemon=True).start()

    def _listen(self) -> None:
        for line in self.process.stdout:
            self.answers.put(line)
        self.answers.put(None)

    def alive(self) -> bool:
        return self.process.poll() is None

    def ask(self, method: str, params: dict, timeout: float | None = TIMEOUT) -> dict:
        """The answer to a request; TimeoutError if it doesn't come in time, the service goes on then."""
        with self.lock:
            self.number += 1
            print(json.dumps({"jsonrpc": "2.0", "id": self.number, "method": method, "params": params}), file=self.process.stdin, flush=True)
            until = None if timeout is None else time.monotonic() + timeout
            while True:
                try:
                    line = self.answers.get(timeout=None if until is None else max(until - time.monotonic(), 0.001))
                except queue.Empty:
                    raise TimeoutError(f"timeout: no answer in {timeout} s") from None
                if line is None:
                    raise RuntimeError("the service has ended")
                try:
                    answer = json.loads(line)
                except ValueError:
                    continue  # a line of another writer
                if isinstance(answer, dict) and answer.get("id") == self.number:
                    return answer

    def search(self, query: str, top_k: int, mode: str, timeout: float | None = TIMEOUT) -> list[dict]:
        answer = self.ask("tools/call", {"name": TOOL["name"], "arguments": {"query": query, "top_k": min(top_k, 100), "mode": mode}}, timeout)
        if "error" in answer:
            raise ValueError(answer["error"]["message"])
        return answer["result"]["structuredContent"].get("results", [])

    def close(self) -> None:
        self.process.kill()
        self.process.wait()


@lru_cache(8)
def _service(db: str | None) -> Resident:
    return Resident(db)


def resident(db: str | None) -> Resident:
    """The service of a folder, started at the first call and again where it has ended."""
    if not (service := _service(db)).alive():
        _service.cache_clear()
        service = _service(db)
    return service


# Answers


def result(text: str, fmt: str | None = None, failed: bool = False) -> dict:
    """A call's answer; one that should be JSON and isn't is an error."""
    if fmt == "json" and not failed:
        try:
            json.loads(text)
        except ValueError:
            failed = True
    return {"content": [{"type": "text", "text": text}], "isError": failed}


def call(raw: object, index: Index | None = None, db: str | None = None, timeout: float | None = TIMEOUT) -> dict:
    """Answers a call: on ``index`` in this process, else by the resident service of the folder ``db``."""
    args = arguments(raw)
    query, top_k = args["query"], args["top_k"]
    if not query.strip():
        return result("missing required argument: query", failed=True)
    try:
        hits = find(index, query, None, top_k, args["mode"]) if index is not None else resident(db).search(query, top_k, args["mode"], timeout)
        return result(render(hits, args["format"], args["max_bytes"], query, top_k) if hits else json.dumps(zero_match(query)), args["format"])
    except Exception as e:  # noqa: BLE001
        return result(str(e), failed=True)
