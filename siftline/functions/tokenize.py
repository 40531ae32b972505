"""Words of code and text as terms, as column expressions; queries are cut by the same rules on the driver."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a word, as a piece of an identifier, and as a term of the index.
CJK = "぀-ヿ㐀-鿿"
WORDS = f"[A-Za-z_][A-Za-z0-9_]*|[{CJK}]+"
PIECES = "[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
TERMS = r"[\p{L}\p{N}\p{Co}]+"
SEVERAL = f"(?<![^ ])([A-Za-z0-9_]*?(?:_|[a-z][A-Z])[A-Za-z0-9_]*|[{CJK}]+)"  # of words between spaces, those that give other terms than themselves
MARKS = r"(?<=[\p{L}\p{N}\p{Co}])[\u0300-\u036F]+"  # written by themselves after a letter


def _folds() -> tuple[str, str]:
    """Latin letters with marks and their plain letters, from Unicode's decompositions."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = unicodedata.normalize("NFD", chr(code))[0].lower()
        if plain.isascii() and plain.isalpha():
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = _folds()


def word_scan(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def identifier_pieces(word: Column) -> Column:
    """``getUserName`` and ``user_name`` cut up, in lower case."""
    return F.transform(F.regexp_extract_all(word, F.lit(PIECES), F.lit(0)), lambda p: F.lower(p))


def cjk_bigrams(run: Column) -> Column:
    n = F.length(run)
    return F.when(n <= 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2))))


def tokens(text: Column) -> Column:
    """Each word in lower case, with its pieces if it is an identifier of several; bigrams of CJK runs."""

    def cut(w: Column) -> Column:
        many = w.contains("_") | w.rlike("[a-z][A-Z]")
        plain = F.concat(F.array(F.lower(w)), F.when(many, identifier_pieces(w)).otherwise(F.array().cast("array<string>")))
        return F.when(w.rlike("^[A-Za-z_]"), plain).otherwise(cjk_bigrams(w))

    return F.coalesce(F.flatten(F.transform(word_scan(text), cut)), F.array().cast("array<string>"))


def body_terms(tokens_: Column) -> Column:
    """Tokens as the index stores them: underscores separate."""
    return F.filter(F.flatten(F.transform(tokens_, lambda t: F.split(t, "_"))), lambda t: t != "")


def text_terms(text: Column) -> Column:
    """``body_terms(tokens(text))``. Most texts have plain words only, which are put in lower case; in the others these are cut together, and only the rest is looked at one by one."""
    none = F.array().cast("array<string>")
    parts = F.split(F.regexp_replace(F.array_join(word_scan(text), " "), F.lit(SEVERAL), F.lit("\n$1\n")), "\n", -1)

    def cut(part: Column, i: Column) -> Column:
        plain = F.when(F.trim(part) == "", none).otherwise(F.split(F.lower(F.trim(part)), " ", -1))
        return F.when(i % 2 == 0, plain).otherwise(body_terms(tokens(part)))

    several = text.contains("_") | text.rlike("[a-z][A-Z]") | text.rlike(f"[{CJK}]")
    return F.coalesce(F.when(several, F.flatten(F.transform(parts, cut))).otherwise(F.transform(word_scan(text), lambda w: F.lower(w))), none)


def path_terms(path: Column) -> Column:
    """A path's runs of letters and digits, in lower case; marks are dropped, whether Latin letters have them or they follow one."""
    return F.regexp_extract_all(F.lower(F.translate(F.regexp_replace(path, MARKS, ""), MARKED, PLAIN)), F.lit(TERMS), F.lit(0))


_SCANNER = re.compile(f"(?P<run>[{CJK}]+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)")
_SEVERAL, _PIECE = re.compile("_|[a-z][A-Z]"), re.compile(PIECES)
_CUT = {
    "run": lambda w: ["".join(p) for p in zip(w, w[1:], strict=False)] or [w],
    "name": lambda w: [x.lower() for x in (w, *(_PIECE.findall(w) if _SEVERAL.search(w) else ()))],
}


def query_tokens(query: str) -> list[str]:
    """The tokens of a query on the driver, by the rules of ``tokens``."""
    return [t for m in _SCANNER.finditer(query) for t in _CUT[m.lastgroup](m.group())]


def query_phrases(query: str) -> list[tuple[str, ...]]:
    """The phrases that a query asks for, one a token; a query without tokens counts as bare words."""
    found = query_tokens(query)
    if found:
        return [tuple(p for p in t.split("_") if p) for t in found]
    words = re.sub("[\u0300-\u036f]+", "", query).split()
    if not words or not all(re.fullmatch(r"\w+", w) for w in words):
        raise ValueError(f"a query needs words: {query!r}")
    return [(w.lower().translate(str.maketrans(MARKED, PLAIN)),) for w in words]


def match_expression(query: str, mode: str = "OR") -> str:
    """The query as quoted terms joined by the mode, as the interfaces show it."""
    if mode not in ("OR", "AND"):
        raise ValueError(f"mode must be OR or AND, not {mode!r}")
    found = query_tokens(query)
    return f" {mode} ".join(f'"{t}"' for t in found) if found else query
