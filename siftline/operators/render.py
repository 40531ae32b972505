"""Answers for callers: Markdown or JSON under a budget of bytes, for the few hits of one query."""

from __future__ import annotations

import json

from siftline.config import DEFAULT, HINT, ZERO_MATCH, Settings


def judge(hits: list[dict], settings: Settings = DEFAULT) -> dict:
    """How far the best hit stands out, by fusion score where there is one."""
    if not hits:
        return {"label": "none", "top_score": None, "runner_up_score": None, "score_gap": None}
    if len(hits) == 1:
        return {"label": "single", "top_score": hits[0]["score"], "runner_up_score": None, "score_gap": None}
    one, two = hits[:2]
    fusion = "fusion_score" in one
    x, y = (abs(h["fusion_score" if fusion else "score"]) for h in (one, two))
    small = y <= 1e-12 if fusion else y < 1e-9
    ratio = (1.0 if not fusion and x < 1e-9 else float("inf")) if small else x / y
    return {"label": "dominant" if ratio >= settings.dominant else "close_contest", "top_score": one["score"], "runner_up_score": two["score"], "score_gap": two["score"] - one["score"]}


def hint(hits: list[dict], top_k: int | None, settings: Settings = DEFAULT) -> str | None:
    if not hits:
        return None
    sparse = len(hits) < max(1, int((settings.top_k if top_k is None else top_k) * settings.sparse_share))
    return HINT if sparse or hits[0]["score"] > settings.weak_score else None


def zero_match(query: str | None = None) -> dict:
    return {"status": "zero_match", "message": ZERO_MATCH} | ({} if query is None else {"query": query})


def envelope(hits: list[dict], query: str | None, top_k: int | None) -> dict:
    return {"status": "ok", "query": query, "count": len(hits), "confidence": judge(hits), "low_confidence_hint": hint(hits, top_k), "results": hits}


def as_json(hits: list[dict], query: str | None = None, top_k: int | None = None, max_bytes: int | None = None) -> str:
    """The envelope; whole hits go from its end until it fits, so that it stays JSON."""
    kept = list(hits)
    while True:
        text = json.dumps(envelope(hits, query, top_k) | {"results": kept}, ensure_ascii=False, indent=2)
        if max_bytes is None or not kept or len(text.encode()) <= max_bytes:
            return text
        kept.pop()


def _hit(place: int, hit_: dict) -> str:
    fused = f"fusion_score: {hit_['fusion_score']:.6f} (matched: {', '.join(hit_.get('matched_queries', []))})\n" if "fusion_score" in hit_ else ""
    return f"## {place}. {hit_['filepath']} (lines {hit_['start_line']}-{hit_['end_line']})\nscore: {hit_['score']:.6f}\n{fused}\n```\n{hit_['raw_snippet']}\n```\n\n"


def as_markdown(hits: list[dict], query: str | None = None, top_k: int | None = None) -> str:
    head = "# BM25 Search Results\n\n" + (f"**Query:** `{query}`\n\n" if query is not None else "")
    if not hits:
        return head + ZERO_MATCH
    c = judge(hits)
    line = f"**Confidence:** {c['label']}"
    if c["label"] not in ("none", "single"):
        line += f" (top: {c['top_score']:.6f}, runner-up: {c['runner_up_score']:.6f}, gap: {c['score_gap']:.6f})"
    advice = hint(hits, top_k)
    body = "".join(_hit(i, h) for i, h in enumerate(hits, 1))
    return f"{head}{line}\n{f'**Hint:** {advice}{chr(10)}' if advice else ''}\n{body}".rstrip() + "\n"


def truncate_bytes(text: str, max_bytes: int | None) -> str:
    if max_bytes is None:
        return text
    return text.encode()[: max(max_bytes, 0)].decode(errors="ignore")


def render(hits: list[dict], fmt: str = "markdown", max_bytes: int | None = DEFAULT.max_bytes, query: str | None = None, top_k: int | None = None) -> str:
    if fmt == "json":
        return as_json(hits, query, top_k, max_bytes)
    return truncate_bytes(as_markdown(hits, query, top_k), max_bytes)
