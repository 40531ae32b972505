"""Settings of the search engine; these are fixed values that its results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# File name endings that are indexed, and the messages of the interfaces.
EXTENSIONS = (
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".astro",
    ".html", ".htm", ".hbs", ".ejs", ".twig", ".php", ".phtml", ".blade.php",
    ".css", ".scss", ".sass", ".less", ".styl",
    ".py", ".go", ".java", ".rs", ".c", ".cpp", ".h",
    ".md", ".json", ".yaml", ".toml", ".sql",
)
ZERO_MATCH = "BM25 match zero. Recommended Fallback: Use standard grep_search or glob to locate exact symbol definitions."
HINT = "Low-confidence match: hit count or top score is weak. Consider re-searching with a synonym or a different granularity keyword (broader/narrower term) before trusting these results."


@dataclass(frozen=True)
class Settings:
    chunk_lines: int = 80
    overlap: int = 20
    look_ahead: int = 10
    path_weight: float = 3.0
    body_weight: float = 1.0
    k1: float = 1.2
    b: float = 0.75
    min_idf: float = 1e-6
    top_k: int = 5
    max_bytes: int = 4000
    near_lines: int = 60
    rrf_k: int = 60
    dominant: float = 1.5
    weak_score: float = -1.0
    sparse_share: float = 0.4

    def pool(self, top_k: int) -> int:
        return max(3 * top_k, 20)


DEFAULT = Settings()
