"""Text functions as native expressions: tokenizers, lines, snippets, paths, ages and sizes."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words the keyword index leaves out.
STOPWORDS = (
    "a an and are as at be but by do else false for from has have if in is it let new not null of on or that the then this to true type use var was when where with"
).split()
#: Between two tokens stands whatever is neither letter, digit nor underscore.
SPLIT = r"[^\p{IsAlphabetic}\p{N}_]+"
SPLIT_SQL = r"[^\p{L}\p{Nl}\p{Nd}\p{No}_]+"


@lru_cache(1)
def decomposed() -> tuple[str, str]:
    """Letters that decompose into one letter and marks, and those letters, position by position (by rule from the Unicode data)."""
    a, b = [], []
    for cp in range(0xC0, 0xFFFF):
        if 0xAC00 <= cp <= 0xD7FF or 0xD800 <= cp <= 0xF8FF:
            continue
        d = unicodedata.normalize("NFKD", chr(cp))
        if len(d) > 1 and d[0].isalnum() and all(unicodedata.category(x)[0] == "M" for x in d[1:]):
            a.append(chr(cp))
            b.append(d[0])
    return "".join(a), "".join(b)


def _ranges(chars: str) -> str:
    """A character class as ranges; a class of single characters is tested one by one."""
    out, start, last = [], None, None
    for c in sorted(map(ord, chars)):
        if start is None or c != last + 1:
            if start is not None:
                out.append((start, last))
            start = c
        last = c
    out.append((start, last))
    return "".join(chr(x) if x == y else f"{chr(x)}-{chr(y)}" for x, y in out)


def split_accents(col: Column) -> Column:
    """Compatibility decomposition for letters with marks, native. A mark ends a word, so a blank stands for it.

    Exact for every letter that is one base letter with marks; ligatures and compatibility forms need ``nfkd``. Plain
    ASCII texts, told by their length in bytes, are left as they are.
    """
    a, b = decomposed()
    plain = F.octet_length(col) == F.length(col)
    return F.when(plain, col).otherwise(F.translate(F.regexp_replace(col, f"([{_ranges(a)}])", "$1 "), a, b))


@F.pandas_udf(StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """Full compatibility decomposition, for texts with ligatures or compatibility forms."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x))


def tokens(col: Column, stopwords=STOPWORDS, decompose: bool = True) -> Column:
    """Keyword tokens, repeats kept: words of at least 2 bytes that are no stopwords, then the parts of words with ``_``."""
    text = F.lower(split_accents(col) if decompose else col)

    def good(w: Column) -> Column:
        long = F.octet_length(w) >= 2
        return long & ~w.isin(*stopwords) if stopwords else long

    words = F.split(text, SPLIT)
    joined = F.array_join(F.filter(words, lambda w: F.contains(w, F.lit("_")) & (F.octet_length(w) >= 2)), "_")
    return F.when(F.contains(text, F.lit("_")), F.concat(F.filter(words, good), F.filter(F.split(joined, "_"), good))).otherwise(F.filter(words, good))


def embedding_tokens(col: Column) -> Column:
    """Tokens for the hash embedding: no decomposition, no stopwords."""
    return tokens(col, (), False)


def query_terms(text: str) -> list[str]:
    """The distinct keyword tokens of a query string, on the driver."""
    import re

    t = unicodedata.normalize("NFKD", text).lower()
    out: list[str] = []
    for w in re.split(r"[^\w]+", "".join(c if c.isalnum() or c == "_" else " " for c in t)):
        if len(w.encode()) < 2:
            continue
        for x in [w, *(p for p in w.split("_") if len(p.encode()) >= 2)] if "_" in w else [w]:
            if x not in STOPWORDS and x not in out:
                out.append(x)
    return out


def lines(col: Column) -> Column:
    """Lines without their ends; no empty line after a last line end; none in an empty text."""
    body = F.regexp_replace(col, r"\r?\n\z", "")
    return F.when(F.length(col) == 0, F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))


def matching_terms(col: Column, terms: list[str]) -> Column:
    """The terms that occur in the lower-cased text, as substrings."""
    low = F.lower(col)
    return F.filter(F.array(*map(F.lit, terms)).cast("array<string>"), lambda t: F.contains(low, t))


def snippet(col: Column, terms: list[str], max_lines: int = 6) -> Column:
    """Up to ``max_lines`` lines around the last of the lines with most different terms; a cut one says so."""
    ls = lines(col)
    hits = F.transform(ls, lambda x, i: F.struct(F.size(matching_terms(x, terms)).alias("n"), i.alias("i")))
    best = F.array_max(hits)["i"]
    n = F.size(ls)
    half = max_lines // 2
    start = F.greatest(best - half, F.lit(0))
    stop = F.least(start + max_lines, n)
    start = F.greatest(stop - max_lines, F.lit(0))
    cut = F.array_join(F.slice(ls, start + 1, stop - start), "\n")
    return F.when(n <= max_lines, F.array_join(ls, "\n")).otherwise(F.concat(cut, F.when(stop < n, F.lit("\n  ...")).otherwise(F.lit(""))))


def highlight(col: Column, term: str, mark: str = "**") -> Column:
    """The first occurrence of a term, whatever its case, between marks."""
    import re

    return F.regexp_replace(col, f"(?is)^(.*?)({re.escape(term)})", f"$1{mark}$2{mark}") if term else col


def shorten_path(path: Column, most: int = 60) -> Column:
    """A path's last ``most`` characters after an ellipsis, if it is longer."""
    return F.when(F.length(path) > most, F.concat(F.lit("…/"), F.substr(path, F.length(path) - most + 1))).otherwise(path)


def last_two(path: Column) -> Column:
    """The last two components of a path."""
    return F.substring_index(path, "/", -2)


def clean_path(path: Column) -> Column:
    """A path with forward slashes and without the long-path prefix."""
    return F.regexp_replace(F.regexp_replace(path, r"^\\\\\?\\", ""), r"\\", "/")


def cloud_path(path: Column) -> Column:
    """A path as ``repository: place below src``; without a folder ``src`` the last two components."""
    m = F.regexp_extract(clean_path(path), r"([^/]+)/src/(.+)$", 0)
    return F.when(m != "", F.concat(F.substring_index(m, "/src/", 1), F.lit(": "), F.substr(m, F.length(F.substring_index(m, "/src/", 1)) + 6))).otherwise(last_two(clean_path(path)))


def http_method(decorator: Column) -> Column:
    """The HTTP method of a route decorator: GET … OPTIONS, or ROUTE; null if it has none."""
    m = F.regexp_extract(decorator, r"\.(get|post|put|delete|patch|head|options)\(", 1)
    return F.when(m != "", F.upper(m)).when(F.contains(decorator, F.lit(".route(")), "ROUTE")


def ago(seconds: Column) -> Column:
    """An age in words."""
    s = seconds.cast("long")
    one = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    return F.when(s < 60, one(s, "s")).when(s < 3600, one(F.floor(s / 60), "min")).when(s < 86400, one(F.floor(s / 3600), "h")).otherwise(one(F.floor(s / 86400), "d"))


def human_size(n: int) -> str:
    """A size in decimal units with one digit."""
    for unit, size in (("GB", 1e9), ("MB", 1e6), ("KB", 1e3)):
        if n >= size:
            return f"{n / size:.1f} {unit}"
    return f"{n} B"


