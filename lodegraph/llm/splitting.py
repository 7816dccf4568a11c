"""Oversized texts cut into pieces under the limits, at natural boundaries, with an overlap.

A hierarchy of separators is tried from the coarsest to the finest: section, paragraph, sentence (in code: statement
line), word, character. A text over the limits is cut at its coarsest separator; parts still over the limits are cut at
the next one. Neighbouring parts are then packed greedily up to the limits. Each piece after the first begins with the
last words of the piece before it, at most ``overlap_words`` of them and whole.

Defined results
* null or empty text, and text at or under both limits: no piece; rows whose id is null are left out.
* a single word longer than the byte limit is cut between characters, never inside one; such a cut has no overlap.
* ``text[start:end]`` of the pieces, without their first ``overlap_chars`` characters, joined in order is the text.
* repeated rows count once; two different texts under one id both give pieces, in the order of their hash.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_WORDS, MAX_BYTES, OVERLAP_WORDS = 400, 4096, 40
_WORD = re.compile(r"[^ \t\r\n]+")

#: Cuts fall before the match's end. From coarse to fine; the last two levels (word, character) need no pattern.
PROSE_LEVELS = (
    re.compile(r"\n(?=[ \t]*(?:#{1,6}[ \t]|={3,}|-{3,}|\[[^\]\n]+\][ \t]*(?:\n|$)))"),
    re.compile(r"\n[ \t]*\r?\n\s*"),
    re.compile(r"(?<=[.!?])[\"')\]]*\s+|\n"),
)
CODE_LEVELS = (
    re.compile(r"\n[ \t]*\r?\n(?=[^\s})\]])|(?<=\n)(?=(?:///?|/\*\*|#\[|@\w|pub\b|fn\b|def\b|class\b|func\b|impl\b|struct\b|function\b|export\b|async\b|public\b|private\b|static\b)(?:(?<!\n[ \t]).)*)"),
    re.compile(r"\n[ \t]*\r?\n\s*|\n(?=[ \t]{1,4}(?:///?|/\*\*|#\[|@\w|pub\b|fn\b|def\b|async\b|public\b|private\b|static\b))"),
    re.compile(r"\n|(?<=[;{}])[ \t]*"),
    re.compile(r"(?<=[,;])[ \t]*"),
)
CODE_TYPES = frozenset(("function", "method", "class", "module", "configblock", "import"))


class _Measure:
    """Words and bytes of any span of a text, without looking at it again."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.words = [m.start() for m in _WORD.finditer(text)]
        self.ends = [m.end() for m in _WORD.finditer(text)]
        self.ascii = text.isascii()
        if not self.ascii:
            at, self.bytes = 0, [0]
            for c in text:
                at += len(c.encode("utf-8", "surrogatepass"))
                self.bytes.append(at)

    def n_words(self, a: int, b: int) -> int:
        """Words of text[a:b]; a word cut by the span counts."""
        return max(0, bisect_left(self.words, b) - bisect_right(self.ends, a))

    def n_bytes(self, a: int, b: int) -> int:
        return b - a if self.ascii else self.bytes[b] - self.bytes[a]

    def fits(self, a: int, b: int, words: int, size: int) -> bool:
        return self.n_bytes(a, b) <= size and self.n_words(a, b) <= words


def _parts(m: _Measure, a: int, b: int, levels: tuple, level: int, words: int, size: int) -> Iterator[tuple[int, int, int]]:
    """Parts of text[a:b] within the limits: (start, end, level of the cut at its end)."""
    if m.fits(a, b, words, size):
        yield a, b, level
        return
    if level < len(levels):
        cuts = sorted({x.end() for x in levels[level].finditer(m.text, a, b) if a < x.end() < b})
        edges = [a, *cuts, b]
        for s, e in zip(edges, edges[1:]):
            yield from _parts(m, s, e, levels, level + 1, words, size)
        return
    if level == len(levels):  # words: a part ends with the blanks after its last word
        i, j = bisect_right(m.ends, a), bisect_left(m.words, b)
        edges = [a, *(m.words[k] for k in range(i + 1, j) if a < m.words[k] < b), b]
        for s, e in zip(edges, edges[1:]):
            yield from _parts(m, s, e, levels, level + 1, words, size)
        return
    while a < b:  # characters
        e = min(b, a + size)
        while not m.ascii and e > a + 1 and m.n_bytes(a, e) > size:
            e = a + max(1, (e - a) * size // m.n_bytes(a, e))
        e = max(e, a + 1)
        yield a, e, level
        a = e


def split(text: str, chunk_type: str | None = None, max_words: int = MAX_WORDS, max_bytes: int = MAX_BYTES, overlap_words: int = OVERLAP_WORDS) -> list[tuple[int, int, int]]:
    """Pieces of ``text``: (start, end, overlap_chars). One piece if the text is within the limits."""
    m = _Measure(text)
    if m.fits(0, len(text), max_words, max_bytes):
        return [(0, len(text), 0)]
    levels = CODE_LEVELS if (chunk_type or "").strip().lower() in CODE_TYPES else PROSE_LEVELS
    # room for the overlap is kept from the start, so a part and the overlap before it always fit together
    over = min(overlap_words, max_words // 4)
    words, size = max_words - over, max_bytes - max_bytes // 8
    parts = list(_parts(m, 0, len(text), levels, 0, words, size))
    pieces: list[tuple[int, int, int]] = []
    at = 0
    while at < len(parts):
        start = parts[at][0]
        o = _overlap(m, start, over, max_bytes // 8) if pieces else start
        if not m.fits(o, parts[at][1], max_words, max_bytes):
            o = start  # limits so small that no overlap has room
        k = at + 1
        while k < len(parts) and m.fits(o, parts[k][1], max_words, max_bytes):
            k += 1
        best = k
        if k < len(parts):  # prefer the coarsest boundary in the second half of the piece
            half = start + (parts[k - 1][1] - start) // 2
            for j in range(k, at, -1):
                if parts[j - 1][1] <= half:
                    break
                if _rank(m.text, parts[j - 1][1]) < _rank(m.text, parts[best - 1][1]):
                    best = j
        pieces.append((o, parts[best - 1][1], start - o))
        at = best
    return pieces


def _rank(text: str, cut: int) -> int:
    """How natural a cut is: 0 before a heading or after a blank line, 1 at a line's end, 2 after a sentence, 3 elsewhere."""
    before = text[max(0, cut - 4) : cut]
    if re.search(r"\n[ \t]*\r?\n\s*$", before):
        return 0
    if before.endswith("\n"):
        return 1
    if re.search(r"[.!?;{}]\s*$", before):
        return 2
    return 3


def _overlap(m: _Measure, start: int, words: int, size: int) -> int:
    """Where the overlap before ``start`` begins: at a word, at most ``words`` words and ``size`` bytes back."""
    if start and not m.text[start - 1].isspace() and start < len(m.text) and not m.text[start].isspace():
        i = bisect_left(m.words, start)
        if i and m.ends[i - 1] > start:
            return start  # the cut is inside a word
    i = bisect_left(m.words, start)
    best = start
    for k in range(i - 1, max(-1, i - 1 - words), -1):
        if m.n_bytes(m.words[k], start) > size:
            break
        best = m.words[k]
    return best


# --- DataFrame operators -----------------------------------------------------------------------------------------


def oversized(df: DataFrame, text: str, max_words: int = MAX_WORDS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows whose text exceeds a limit, counted from the text itself. Words are only counted where there are bytes enough for them."""
    t = F.col(text)
    return df.where((F.octet_length(t) > max_bytes) | ((F.octet_length(t) > 2 * max_words) & (F.regexp_count(t, F.lit(r"[^ \t\r\n]+")) > max_words)))


def split_oversized(df: DataFrame, record_id: str = "id", text: str = "content", kind: str = "chunk_type", max_words: int = MAX_WORDS, max_bytes: int = MAX_BYTES, overlap_words: int = OVERLAP_WORDS) -> DataFrame:
    """(chunk_id, version, piece_no, start, end, overlap_chars, n_words, n_bytes, text): the pieces of every oversized row.

    ``version`` is 0 but where one id has several texts. Only oversized rows reach Python; they are shuffled once, by id,
    so that repeats fall together and long texts spread over the workers.
    """
    d = oversized(df.where(F.col(record_id).isNotNull()), text, max_words, max_bytes).select(
        F.col(record_id).cast("long").alias("chunk_id"), F.col(kind).cast("string").alias("kind"), F.col(text).alias("text")
    )
    d = d.withColumn("h", F.xxhash64("text")).dropDuplicates(["chunk_id", "h"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, h, k, t in zip(b["chunk_id"], b["h"], b["kind"], b["text"]):
                m = _Measure(t)
                for no, (s, e, o) in enumerate(split(t, k, max_words, max_bytes, overlap_words)):
                    rows.append((i, h, no, s, e, o, m.n_words(s, e), m.n_bytes(s, e), t[s:e]))
            if rows:
                yield pd.DataFrame(rows, columns=["chunk_id", "version", "piece_no", "start", "end", "overlap_chars", "n_words", "n_bytes", "text"])

    return d.mapInPandas(cut, "chunk_id long, version long, piece_no int, start int, end int, overlap_chars int, n_words int, n_bytes int, text string")
