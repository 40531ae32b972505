"""Lines, bytes and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.config import EXTENSIONS

BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
BLANK = r"^[\s\x1c-\x1f\x85\p{Z}]*$"


def decoded(content: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def lines(text: Column) -> Column:
    cut = F.split(F.coalesce(text, F.lit("")), BREAK, -1)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


def is_blank(line: Column) -> Column:
    return line.rlike(BLANK)


def matches_extension(path: Column, extensions: tuple[str, ...] | None = None) -> Column:
    """Whether the file name ends in one of the suffixes and has something before it."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    out = F.lit(False)
    for e in extensions if extensions is not None else EXTENSIONS:
        e = e.lower() if e.startswith(".") else f".{e.lower()}"
        out = out | (name.endswith(e) & (F.length(name) > len(e)))
    return out


def truncated(text: Column, n: int | None) -> Column:
    """At most ``n`` bytes of UTF-8 that end with a whole character."""
    if n is None:
        return text
    if n <= 0:
        return F.when(text.isNotNull(), F.lit(""))
    raw = text.cast("binary")
    cuts = [F.substring(raw, 1, m).cast("string") for m in range(n, max(n - 4, -1), -1)]
    return F.when(F.octet_length(text) <= n, text).otherwise(F.coalesce(*(F.when(F.is_valid_utf8(c), c) for c in cuts)))
