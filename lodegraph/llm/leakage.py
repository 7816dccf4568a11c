"""Passages of evaluation items inside a corpus, found by pigeonhole edit matching on words.

A window of L words that a document holds with at most e word edits, cut into e + 1 pieces, has one piece the document
holds exactly. Every window here is long enough for pieces of ``PIECE`` words, so the index of all word ``PIECE``-grams
of the items finds every such place; a bit-parallel (Myers) edit distance then verifies the windows around it.

What does not count
* wording that is not the item's own: sentences that several different items have in common, and standing text: what a
  large share of all documents holds, each in other company and without the rest of the item. Copies and near copies of a
  document are one place, and a sentence that mostly comes with half of its item is the item's, however many hold it;
* a sentence pattern filled with other content: of a window's own words (those few items of its suite use) two thirds
  must be there, and four, besides the edit distance.

Defined results
* null, empty or short texts on either side give no row; documents or items with a null id are left out.
* case, punctuation, markup, comment marks and line breaks do not matter: words are runs of letters and digits.
* items repeated under other ids each count; repeated rows count once; a document's leak counts once per item.
* the items are read to the driver in blocks of at most ``BLOCK_CHARS`` characters, whatever their number; each block is
  one pass over the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Windows (words, edits allowed). Pieces of PIECE words: 20 // 3, 30 // 4, 40 // 6 are all at least that long.
WINDOWS = ((20, 2), (30, 3), (40, 5))
PIECE = 6
#: A sentence is common from so many different items on, standing text from this share of the documents on (and so many),
#: if in this share of its places it stands apart from the rest of its item.
COMMON_ITEMS, STANDING_SHARE, STANDING_DOCS, STANDING_APART = 3, 0.01, 20, 0.9
#: Documents with one of these bands of minimum hashes in common are copies: their words besides the item's are the same.
BANDS, BAND_ROWS, SHINGLE = 8, 4, 3
#: A word of a suite is its pattern's, not an item's own, from this share of the suite's items on.
PATTERN_SHARE = 0.42
#: Of a window's own words this share must be there, and at least so many.
OWN_SHARE, OWN_WORDS = 2 / 3, 4
BLOCK_CHARS = 8_000_000

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def edit_distance(pattern: list, text: list) -> int:
    """The least number of word edits that turn ``pattern`` into some run of ``text`` (Myers 1999, any pattern length)."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        if score < best:
            best = score
    return best


class EvalIndex:
    """The items of one block: their distinct texts as word numbers, own words, sentences, and all their pieces."""

    def __init__(self, items: list[tuple[int, str, str]], common: set[tuple[str, ...]], pattern_words: dict[str, set[str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.ids: list[list[int]] = []
        self.texts: list[list[int]] = []
        self.own: list[list[bool]] = []
        self.sentence: list[list[int]] = []
        self.sentence_hash: list[int] = []
        by_text: dict[tuple[str, ...], int] = {}
        numbers: dict[tuple[str, ...], int] = {}
        for item_id, suite, text in items:
            key = tuple(words(text))
            if key in by_text:
                self.ids[by_text[key]].append(item_id)
                continue
            by_text[key] = len(self.ids)
            seq, own, sent = [], [], []
            pattern = pattern_words.get(suite or "", set())
            for s in _SENTENCE.split(text):
                w = tuple(words(s))
                if not w:
                    continue
                n = numbers.setdefault(w, len(numbers))
                for x in w:
                    seq.append(-1 if w in common else self.vocabulary.setdefault(x, len(self.vocabulary) + 1))
                    own.append(w not in common and x not in pattern)
                    sent.append(n)
            self.ids.append([item_id])
            self.texts.append(seq)
            self.own.append(own)
            self.sentence.append(sent)
        self.sentence_hash = [int(pd.util.hash_array(np.array([" ".join(w)], object))[0].view(np.int64)) for w in numbers]
        keys, at = [], []
        for t, seq in enumerate(self.texts):
            if len(seq) >= PIECE:
                a = np.array(seq, np.int64)
                k, ok = _piece_keys(a)
                keys.append(k[ok])
                at.append(np.stack([np.full(ok.sum(), t), np.flatnonzero(ok)], 1))
        k = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        p = np.concatenate(at) if at else np.empty((0, 2), np.int64)
        order = np.argsort(k, kind="stable")
        self.keys, first = np.unique(k[order], return_index=True)
        self.first = np.append(first, len(k))
        self.places = p[order]

    # -- one batch of documents
    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, dict[int, int], int]]:
        """(document, text, words matched by sentence, edits) for each document that holds a window of a text."""
        get = self.vocabulary.get
        docs = [[get(w, 0) for w in words(t)] for t in texts]
        starts, parts, at = [], [], 0
        gap = np.zeros(PIECE, np.int64)
        for d in docs:
            starts.append(at)
            parts += [np.array(d, np.int64), gap]
            at += len(d) + PIECE
        flat = np.concatenate(parts) if parts else gap
        if len(flat) < PIECE or not len(self.keys):
            return []
        k, ok = _piece_keys(flat)
        where = np.flatnonzero(ok)
        if not len(where):
            return []
        slot = np.minimum(np.searchsorted(self.keys, k[where]), len(self.keys) - 1)
        hit = self.keys[slot] == k[where]
        where, slot = where[hit], slot[hit]
        of = np.searchsorted(np.array(starts), where, side="right") - 1
        out = []
        for d in np.unique(of):
            mine = of == d
            lines: dict[tuple[int, int], list[int]] = defaultdict(list)
            for pos, s in zip((where[mine] - starts[d]).tolist(), slot[mine].tolist()):
                for t, q in self.places[self.first[s] : self.first[s + 1]].tolist():
                    lines[t, pos - q].append(pos)
            by_text: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
            for (t, diagonal), ps in lines.items():
                a = b = ps[0]
                for p in [*ps[1:], None]:
                    if p is not None and p - b <= PIECE:
                        b = p
                        continue
                    by_text[t].append((diagonal, a, b + PIECE))
                    a = b = p if p is not None else 0
            for t, runs in by_text.items():
                got = self._verify(t, docs[d], runs)
                if got:
                    out.append((int(d), t, got))
        return out

    def context(self, t: int, by_sentence: dict[int, int], text: str) -> list[int]:
        """Bands of minimum hashes of what a document says besides the sentences it holds of an item."""
        mine = {self.texts[t][k] for k, s in enumerate(self.sentence[t]) if s in by_sentence}
        get = self.vocabulary.get
        rest = [w for w in words(text) if get(w, 0) not in mine]
        return _bands(rest)

    def with_item(self, t: int, by_sentence: dict[int, int]) -> bool:
        """Whether half of the item's words, common sentences left out, are there."""
        return 2 * sum(by_sentence.values()) >= sum(x > 0 for x in self.texts[t])

    def _verify(self, t: int, doc: list[int], runs: list[tuple[int, int, int]]) -> dict[int, int]:
        seq, own = self.texts[t], self.own[t]
        covered: set[int] = set()
        tried: set[tuple[int, int, int]] = set()
        for diagonal, a, b in runs:
            for size, edits in WINDOWS:
                lo, hi = max(0, a - diagonal - size + PIECE), min(len(seq), b - diagonal + size - PIECE)
                if hi - lo < size:
                    continue
                left, right = max(0, lo + diagonal - edits), hi + diagonal + edits
                region = set(doc[left:right])
                there = [x > 0 and x in region for x in seq[lo:hi]]
                n = sum(there[:size])
                for s in range(lo, hi - size + 1):
                    if s > lo:
                        n += there[s + size - 1 - lo] - there[s - 1 - lo]
                    if n < size - edits or (s, size, diagonal) in tried:
                        continue
                    tried.add((s, size, diagonal))
                    if all(k in covered for k in (s, s + size - 1)) and sum(k in covered for k in range(s, s + size)) == size:
                        continue
                    c = max(0, s + diagonal - edits)
                    piece = doc[c : s + diagonal + size + edits]
                    window = seq[s : s + size]
                    if -1 in window:
                        continue
                    mine = [x for x, o in zip(window, own[s : s + size]) if o]
                    held = set(piece)
                    if sum(x in held for x in mine) < max(OWN_SHARE * len(mine), OWN_WORDS):
                        continue
                    if edit_distance(window, piece) <= edits:
                        covered.update(range(s, s + size))
        return dict(Counter(self.sentence[t][k] for k in covered))


def _piece_keys(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every PIECE neighbours, and where all of them are words of the vocabulary."""
    n = len(a) - PIECE + 1
    k = np.zeros(n, np.uint64)
    ok = np.ones(n, bool)
    with np.errstate(over="ignore"):
        for j in range(PIECE):
            x = a[j : j + n]
            k = (k ^ (k >> np.uint64(31))) * _MUL + x.astype(np.uint64)
            ok &= x > 0
    return k, ok


_SEEDS = np.random.default_rng(6).integers(1, 2**63, BANDS * BAND_ROWS, np.uint64) | np.uint64(1)


def _bands(ws: list[str]) -> list[int]:
    if not ws:
        return [0] * BANDS
    h = pd.util.hash_array(np.array(ws, object))
    n = max(1, len(h) - SHINGLE + 1)
    k = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(SHINGLE, len(h))):
            k = (k ^ (k >> np.uint64(31))) * _MUL + h[j : j + n]
        low = []
        for seed in _SEEDS:  # one at a time: a long text is not held once for each seed
            x = (k ^ (k >> np.uint64(29))) * seed
            low.append((x ^ (x >> np.uint64(32))).min())
        m = np.array(low).reshape(BANDS, BAND_ROWS)
        out = np.zeros(BANDS, np.uint64)
        for j in range(BAND_ROWS):
            out = (out ^ (out >> np.uint64(31))) * _MUL + m[:, j]
    return out.view(np.int64).tolist()


def prepare(items: list[tuple[int, str, str]]) -> tuple[set[tuple[str, ...]], dict[str, set[str]]]:
    """Sentences that COMMON_ITEMS different items share, and the pattern words of each suite."""
    seen: dict[tuple[str, ...], set] = defaultdict(set)
    suites: dict[str, dict[tuple[str, ...], set[str]]] = defaultdict(dict)
    for _, suite, text in items:
        key = tuple(words(text))
        if not key:
            continue
        suites[suite or ""][key] = set(key)
        for s in _SENTENCE.split(text):
            w = tuple(words(s))
            if w:
                seen[w].add(key)
    common = {w for w, k in seen.items() if len(k) >= COMMON_ITEMS}
    pattern = {}
    for s, texts in suites.items():
        n = Counter(w for ws in texts.values() for w in ws)
        pattern[s] = {w for w, c in n.items() if c >= PATTERN_SHARE * len(texts) and c >= COMMON_ITEMS}
    return common, pattern


def shared_wording(items: DataFrame) -> tuple[set[tuple[str, ...]], dict[str, set[str]]]:
    """As ``prepare``, over a table of items whatever its size; only what counts as shared comes to the driver."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for suite, text in zip(b["suite"], b["text"]):
                ws = words(text)
                if not ws:
                    continue
                key, suite = hashlib.md5(" ".join(ws).encode("utf-8", "surrogatepass")).digest(), suite or ""
                out.append((key, suite, 0, ""))
                out += [(key, suite, 1, w) for w in set(ws)]
                out += [(key, suite, 2, w) for w in {" ".join(words(s)) for s in _SENTENCE.split(text)} - {""}]
            if out:
                yield pd.DataFrame(out, columns=["key", "suite", "what", "wording"])

    parts = items.select("suite", "text").mapInPandas(read, "key binary, suite string, what int, wording string").distinct()
    n = cut(parts.groupBy("what", F.when(F.col("what") < 2, F.col("suite")).alias("suite"), "wording").agg(F.count_distinct("key").alias("n")).where((F.col("what") == 0) | (F.col("n") >= COMMON_ITEMS)))
    size = {r["suite"]: r["n"] for r in n.where("what = 0").collect()}
    pattern: dict[str, set[str]] = {s: set() for s in size}
    sizes = n.where("what = 0").select("suite", F.col("n").alias("size"))
    for r in n.where("what = 1").join(sizes, "suite").where(F.col("n") >= PATTERN_SHARE * F.col("size")).select("suite", "wording").toLocalIterator():
        pattern[r["suite"]].add(r["wording"])
    return {tuple(r["wording"].split(" ")) for r in n.where("what = 2").select("wording").toLocalIterator()}, pattern


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, n_words): each document with the items whose own wording it holds; words of the item matched."""
    spark = documents.sparkSession
    d = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("suite").cast("string"), "text").distinct()
    shared = shared_wording(rows)
    found, block, size = [], [], 0

    def scan(block: list[tuple[int, str, str]]) -> DataFrame:
        index = spark.sparkContext.broadcast(EvalIndex(block, *shared))

        def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x = index.value
            for b in batches:
                out = []
                for at, t, by_sentence in x.leaks(list(b["text"])):
                    hashes = [x.sentence_hash[s] for s in by_sentence]
                    context, whole = x.context(t, by_sentence, b["text"].iloc[at]), x.with_item(t, by_sentence)
                    for i in x.ids[t]:
                        out.append((b["doc_id"].iloc[at], i, hashes, list(by_sentence.values()), context, whole))
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "item_id", "sentences", "n", "context", "whole"])

        return d.mapInPandas(match, "doc_id long, item_id long, sentences array<long>, n array<int>, context array<long>, whole boolean")

    # one item at a time comes to the driver, and no more than a block of them is held
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        block.append((r[0], r[1], r[2]))
        size += len(r[2])
        if size >= block_chars:
            found.append(scan(block))
            block, size = [], 0
    if block or not found:
        found.append(scan(block))
    m = found[0]
    for f in found[1:]:
        m = m.unionByName(f)
    m = cut(m)  # the matches are read for the standing text and for the result; the corpus is searched once
    total = d.agg(F.count_distinct("doc_id").alias("n_docs"))
    by_sentence = m.select("doc_id", "item_id", F.explode(F.arrays_zip("sentences", "n")).alias("z")).select("doc_id", "item_id", F.col("z.sentences").alias("sentence"), F.col("z.n").alias("n"))
    by_sentence = by_sentence.groupBy("doc_id", "item_id", "sentence").agg(F.max("n").alias("n"))
    standing = standing_text(m, total)
    own = by_sentence.join(standing, "sentence", "left_anti")
    return own.groupBy("doc_id", "item_id").agg(F.sum("n").cast("int").alias("n_words")).where(F.col("n_words") >= WINDOWS[0][0])


def standing_text(matches: DataFrame, total: DataFrame) -> DataFrame:
    """(sentence): those that a large share of the documents hold, in different places and apart from their item.

    Only sentences that enough documents hold, copies included, are looked at. A place is a document that shares no band
    of its context with an earlier one, so a group of copies is one place or a few.
    """
    enough = lambda n: (F.col(n) >= STANDING_DOCS) & (F.col(n) >= STANDING_SHARE * F.col("n_docs"))
    held = matches.select("doc_id", "context", "whole", F.explode("sentences").alias("sentence"))
    often = held.groupBy("sentence").agg(F.count_distinct("doc_id").alias("df")).join(F.broadcast(total)).where(enough("df")).select("sentence")
    held = held.join(often, "sentence", "left_semi")
    bands = held.select("sentence", "doc_id", "whole", F.posexplode("context").alias("i", "band"))
    first = bands.groupBy("sentence", "i", "band").agg(F.min("doc_id").alias("first"))
    places = (
        bands.join(first, ["sentence", "i", "band"]).groupBy("sentence", "doc_id").agg(F.min("first").alias("first"), F.max("whole").alias("whole"))
        .where("first = doc_id").groupBy("sentence").agg(F.count("*").alias("n"), F.count_if(~F.col("whole")).alias("apart"))
    )
    return places.join(F.broadcast(total)).where(enough("apart") & (F.col("apart") >= STANDING_APART * F.col("n"))).select("sentence")
