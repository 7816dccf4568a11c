"""Files nobody wrote by hand: generated, minified, third-party copies, lock files, data dumps in code form.

Every chunk is read once. Its normalised token stream (comments and blanks dropped, case folded, numbers masked) is
fingerprinted by winnowing. Files whose fingerprints largely recur across several unrelated repositories, or in code of
another repository that is known to be third-party (by its folder or its own notes), are copies.
The same pass takes down what the text itself says: the notes in the comment that opens the file, and how many of its
characters stand in minified lines, in data, in rows of a table, in the entries of a lock file. All of it is added up
by file; nothing depends on how a file was cut into chunks or how many files there are.

Defined results
* null or empty content gives no evidence of its own; the path still may tell. Rows whose file_path is null are left out.
* repeated rows (same id and path) count once; tombstoned chunks count like others; extra columns are ignored.
* an empty table gives no rows. Ignore patterns are reported beside the evidence and never decide alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# --- winnowing ---------------------------------------------------------------------------------------------------

#: Tokens in a fingerprinted gram, and grams in a window: any common run of GRAM + WINDOW - 1 tokens shares a fingerprint.
GRAM, WINDOW = 40, 24
_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|(?m:^)[ \t]*\#(?!\[|include|define|if|endif)[^\n]*|([a-z_$]+|\d+|[^\s\w])", re.S)
_BASE = np.uint64(0x9E3779B97F4A7C15)
class _Hashes(dict):
    """The hash of each token; all numbers have one. Emptied when it has grown large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest("0" if token.isdigit() else token)
        return h


_HASHES = _Hashes()


def fingerprints(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> list[np.ndarray]:
    """The winnowed fingerprints of each text, distinct. Texts with fewer tokens than a gram have none."""
    out: list[np.ndarray] = []
    block: list[np.ndarray] = []
    size = 0
    for t in texts:
        toks = [x for x in _TOKEN.findall(t.lower()) if x] if t else []
        block.append(np.fromiter(map(_HASHES.__getitem__, toks), np.uint64, len(toks)))
        size += len(toks)
        if size > 1_000_000:
            out += _winnow(block, gram, window)
            block, size = [], 0
    return out + _winnow(block, gram, window)


def _rolling(s: np.ndarray, gram: int) -> np.ndarray:
    """The polynomial hash of every ``gram`` neighbours, by doubling."""
    have, h, done, out, power = 1, s, 0, None, _BASE
    while True:
        if gram & have:  # out covers the first ``done`` tokens of a gram, h the next ``have``
            n = len(s) - done - have + 1
            out = h if out is None else out[:n] * power + h[done : done + n]
            done += have
        if done == gram:
            return out[: len(s) - gram + 1]
        h = h[: len(h) - have] * power + h[have:]
        have, power = have * 2, power * power


def _extreme(h: np.ndarray, window: int, least) -> np.ndarray:
    """The least (or greatest) of every ``window`` neighbours, by doubling."""
    have, m = 1, h
    while have * 2 <= window:
        m = least(m[: len(m) - have], m[have:])
        have *= 2
    n = len(h) - window + 1
    return least(m[:n], m[window - have : window - have + n])


def _winnow(block: list[np.ndarray], gram: int, window: int) -> list[np.ndarray]:
    """Winnows many streams at once: they are laid end to end, and no gram or window crosses from one to the next."""
    lengths = np.array([len(b) for b in block])
    full = np.iinfo(np.uint64).max
    pad = np.full(gram + window, full, np.uint64)  # between streams: nothing there is ever the least
    starts, parts, at = [], [], 0
    for b in block:
        starts.append(at)
        parts += [b, pad]
        at += len(b) + len(pad)
    if not parts:
        return []
    s = np.concatenate([*parts, pad])
    with np.errstate(over="ignore"):
        h = _rolling(s, gram)
        h ^= h >> np.uint64(29)
    valid = np.zeros(len(h), bool)
    for st, n in zip(starts, lengths):
        valid[st : st + max(0, n - gram + 1)] = True
    h[~valid] = full
    least = _extreme(h, window, np.minimum)
    lead = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    most = _extreme(lead, window, np.maximum)
    chosen = valid & (most == h)
    # a stream shorter than a window is one window
    out = []
    for st, n in zip(starts, lengths):
        g = max(0, n - gram + 1)
        hs = h[st : st + g]
        c = hs[chosen[st : st + g]] if g >= window else (hs[:0] if not g else np.array([hs.min()], np.uint64))
        out.append(np.unique(c).view(np.int64))
    return out


# --- what a text says of itself ----------------------------------------------------------------------------------

_COMMENT_LINE = re.compile(r"^\s*(?://+!?|/\*+!?|\*+/?|#+!?|--+|;+|<!--|%+|>+|\"\"\"|''')\s?(?P<t>.*?)\s*(?:\*/|-->)?\s*$")
# Notes are told by what words of a few classes say together, not by whole phrases.
_MADE = r"(?:generated|created|produced|written|assembled|built|compiled|derived|extracted|emitted)"
_BY_ITSELF = r"(?:auto(?:matically)?|mechanically|machine)[- ]?"
_CHANGE = r"(?:edit|modify|change|touch|alter)"
_CHANGES = r"(?:edits|changes|modifications|edited)"
_THIS = r"(?:this|the) (?:file|code|source|page|module|output|document)"
#: Made by itself, or out of something; or a change to it is unwanted, in vain, or to be made elsewhere.
GENERATED_NOTE = re.compile(
    rf"(?i)@generated\b|<auto-?generated|\b{_BY_ITSELF}{_MADE}\b(?! stub)(?:[,.:;(]|$|.*\b(?:by|from|out of|with|file|do not|don't)\b|(?: \w+){{0,3}}[.;])"
    rf"|\b(?:code|file|source|this (?:file|code|module|page|document))\s+(?:(?:is|was|has been)\s+)?(?:{_BY_ITSELF})?{_MADE}\s+(?:automatically|by|from|with|out of|using|on)\b"
    rf"|\b{_MADE} (?:by|from)\b|\b{_MADE}(?: file)?[:;,]\s*(?:do not|don't)\b|\b{_CHANGE}\b[^.;]*\b(?:instead of|not) this\b|\b{_CHANGES}\b[^.;]*\b(?:lost|overwritten|discarded)\b|\bregenerate with\b"
    r"|automatisch (?:erzeugt|generiert|erstellt)|nicht (?:manuell )?bearbeiten\b|generado autom[aá]ticamente|(?:g[eé]n[eé]r[eé]|cr[eé][eé]) automatiquement|no editar\b"
)
#: Taken from elsewhere; or a name with a version, or a licence that others grant.
THIRD_PARTY_NOTE = re.compile(
    r"(?i)\b(?:third[- ]party|vendored|unmodified|verbatim) (?:snapshot|copy|code|import|version) (?:of|from)\b|\b(?:copied|imported|taken|mirrored|vendored) (?:verbatim |unchanged |unmodified )?from (?:(?:the )?[\w.-]+ (?:distribution|release|project|repository|repo|library|sources?)\b|[\w.-]+,? (?:commit|version|release|tag|v?\d))|^\s*upstream:\s*\S"
    r"|\b(?:contributors|authors)\b.*\b(?:released|licen[sc]ed|distributed) under\b|\blicen[sc]ed under the\b.*\b(?:authors|contributors)\b|\bredistribution and use\b|\bpermission is hereby granted\b|^!?\s*[\w.@/-]+ (?:version |release )?v?\d+\.\d+(?:\.\d+)?\b(?:\s*$|(?<=\d)\s*[|,(*-])|^!?\s*[\w.@/-]+ v\d+\.\d+"
)
LOCK_NOTE = re.compile(rf"(?i)\b{_MADE} by the (?:dependency )?(?:resolver|package manager)\b|\block[- ]?file\b.*\b(?:do not|{_MADE})\b|\block(?:[- ]?file)?[ _-]?(?:format|version)\b[\"':= ]*\d")
#: Not what the rest of the note may look like; by hand; or about a tool that makes other files.
NOT_SO = re.compile(rf"(?i)\b(?:not|no longer|never) (?:vendored|minified|third[- ]party|{_MADE})|\b(?:written|kept|maintained|edited) by hand\b|\bhand[- ]?(?:written|kept|maintained|edited)\b|\b(?:the|a|our) (?:generator|script|tool|compiler)\b[^.;]*\b(?:writes|emits|adds|produces|creates)\b")

#: A line without one of these, or a number with a point, matches none of the patterns above.
_STEMS = tuple(
    "generat generado creat produc writ assembl built compil deriv extract emit instead this lost overwrit discard automati bearbeit editar "
    "third vendored unmodified verbatim copied imported taken mirrored upstream contributors authors redistribution permission lock resolver manager".split()
)
_POINT = re.compile(r"\d\.\d")

_SKELETON = re.compile(r"0x[0-9a-f]+|\d+", re.I)
_DATA = re.compile(r"""[-+]?(?:0x[0-9a-fA-F]+|\d[\d_]*\.?\d*(?:[eE][-+]?\d+)?)[uUlLfF]?\d*|\\x[0-9a-fA-F]{2}|[A-Za-z0-9+/=]{48,}|\b[0-9a-fA-F]{16,}\b""")
_LOCK_LINE = re.compile(r"""(?i)\b(?:integrity|checksum|sha(?:1|256|384|512)|hash|resolved)["']?\s*[:=]\s*["'{]?|^\s*\[\[package\]\]|^\s*["']?version["']?\s*[:=]\s*["']?\d+\.\d+|@\d+\.\d+\.\d+[:{"]|sha(?:256|384|512)-[A-Za-z0-9+/]{20,}|^\s*name\s*=\s*"|==\d+\.\d+(?:\.\d+)?\s*(?:\\|--hash)|\bh1:[A-Za-z0-9+/]{30,}=|^[-*+] `[^`]+`.*\b(?:line |:)\d+$""")
CODE = frozenset("rs py pyi js jsx mjs cjs ts tsx go java c h cc cpp cxx hpp hh kt rb php cs swift scala css sh bash sql".split())


def _lines(text: str) -> Iterator[str]:
    """The lines of a text, one at a time."""
    at = 0
    while (e := text.find("\n", at)) >= 0:
        yield text[at:e]
        at = e + 1
    yield text[at:]


def _may_note(line: str) -> bool:
    low = line.lower()
    return any(x in low for x in _STEMS) or bool(_POINT.search(low))


def head_notes(text: str) -> tuple[int, int, int]:
    """(generated, third party, lock) as the comment lines that open the text say."""
    g = v = k = 0
    quote = False
    for n, line in enumerate(_lines(text)):
        s = line.strip()
        if not s:
            continue
        m = _COMMENT_LINE.match(line)
        if not m and not quote:
            if any(x in s.lower() for x in ("lock", "resolver", "manager")) and LOCK_NOTE.search(s):
                k = 1
            if s in "{[" or s.startswith(("#!", "package ", "<?")) or n == 0 and s.startswith("'use strict"):
                continue
            break
        t = m["t"] if m else s
        if s.startswith("/*") and "*/" not in s:
            quote = True
        if "*/" in s:
            quote = False
        if not _may_note(t) or NOT_SO.search(t):
            continue
        k |= bool(LOCK_NOTE.search(t))
        g |= bool(GENERATED_NOTE.search(t))
        v |= bool(THIRD_PARTY_NOTE.search(t))
    return g, v, k


_ARMORED = re.compile(r"-----BEGIN [^-\n]+-----.*?(?:-----END [^-\n]+-----|\Z)", re.S)
#: Without one of these a text holds no lock entries; the line patterns are only tried where one is there.
_LOCK_HINTS = ("integrity", "checksum", "sha", "version", "hash", "resolved", "==", "@", "h1:", "[[package", "line ", ".rs:", ".py:")
#: The same for a line: each alternative of the pattern holds one.
_LINE_HINTS = ("integrity", "checksum", "sha", "version", "hash", "resolved", "==", "@", "h1:", "[[package", "name", "`")


def features(text: str) -> tuple[int, int, int, int, int, int, int]:
    """(characters, in minified lines, in data, lines, lines of a table, lock lines, source map notes)"""
    if "-----BEGIN" in text:  # a key is no data of its own
        text = _ARMORED.sub("", text)
    total, lines = len(text), text.count("\n") + 1
    digits = sum(map(text.count, "0123456789"))
    mini = data = table = lock = 0
    maps = text.count("//# sourceMappingURL")
    numeric = digits >= 0.04 * total
    dense = digits >= 0.12 * total or max(map(len, text.split()), default=0) >= 48
    low = text.lower()
    locks = any(h in low for h in _LOCK_HINTS)
    rows = text.split("\n")
    if not (numeric or dense or locks) and max(map(len, rows)) <= 160:
        return total, 0, 0, lines, 0, 0, maps
    before = None
    alike = False
    for line in rows:
        s = line.strip()
        n = len(s)
        if n > 160 and s.count(" ") / n < 0.12:
            marks = sum(map(s.count, ";{}(),=")) / n
            if marks > (0.08 if s.count(" ") / n < 0.09 else 0.12):
                mini += n
        if dense and n:
            d = sum(map(len, _DATA.findall(s)))
            if d:
                rest = n - d - sum(map(s.count, " ,;:\"'()[]{}\\+"))
                if rest <= 0.15 * n or (d >= 48 and rest <= 0.4 * n):
                    data += n
        if locks and n and any(map(s.lower().__contains__, _LINE_HINTS)) and _LOCK_LINE.search(s):
            lock += 1
        if numeric and n > 3:
            k = _SKELETON.sub("0", s)
            if k == before and k != s:
                table += 1 if alike else 2
                alike = True
            else:
                alike = False
            before = k
    return total, mini, data, lines, table, lock, maps


_FIELDS = "n_chars mini data n_lines table lock maps".split()
_OUT = "id long, file_path string, line_start int, generated int, third_party int, lock_note int, " + ", ".join(f"{x} long" for x in _FIELDS) + ", fps array<long>"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = [t or "" for t in b["content"]]
        notes = [head_notes(t) for t in texts]
        feats = [features(t) for t in texts]
        out = pd.DataFrame({"id": b["id"], "file_path": b["file_path"], "line_start": b["line_start"].fillna(1).astype("int32")})
        for i, k in enumerate(("generated", "third_party", "lock_note")):
            out[k] = [n[i] for n in notes]
        for i, k in enumerate(_FIELDS):
            out[k] = [f[i] for f in feats]
        out["fps"] = fingerprints(texts)
        yield out


# --- DataFrame operators -----------------------------------------------------------------------------------------

#: Directories that hold third-party copies, whole path segments. Build output directories are not among them: what lies
#: there is known by its content.
THIRD_PARTY_DIRS = ("node_modules", "bower_components", "third_party", "thirdparty", "third-party", "vendor", "vendored", "_vendor", "Pods", "site-packages", "external", "deps", "extern", "3rdparty")
#: A copy recurs in at least so many repositories, with at least this share of its fingerprints and so many of them.
MIN_REPOS, MIN_SHARE, MIN_PRINTS = 3, 0.5, 6


def repository(path):
    """The first two path segments name a repository, whatever the case and the slashes; a path without them is its own."""
    p = F.lower(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"/(?:\./|/)+", "/"))
    return F.coalesce(F.nullif(F.regexp_extract(p, r"^(/?[^/]+/[^/]+)/", 1), F.lit("")), p)


def in_third_party_folder(path):
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, THIRD_PARTY_DIRS)))


def chunk_evidence(chunks: DataFrame) -> DataFrame:
    """One row per chunk with its evidence and fingerprints; repeats dropped; written once to the shared folder."""
    d = chunks.where("file_path is not null").select("id", "file_path", "line_start", "content")
    return cut(d.mapInPandas(_read, _OUT).dropDuplicates(["id", "file_path"]))


def recurring_share(evidence: DataFrame, min_repos: int = MIN_REPOS) -> DataFrame:
    """(file_path, n_prints, n_recurring, n_known): a file's fingerprints, how many of them occur in ``min_repos``
    repositories, and how many in third-party code of another repository.

    Known third-party code seeds the index: chunks in folders of such code, and those whose opening comment says so.
    Fingerprints are first made distinct by repository, map-side, so one that is everywhere costs each map task one row a
    repository; a row a fingerprint then goes to the files that have it.
    """
    seed = (in_third_party_folder(F.col("file_path")) | (F.col("third_party") > 0)).cast("int")
    # the repository is told before the prints are laid out in rows: once a chunk
    p = evidence.select("file_path", F.xxhash64(repository(F.col("file_path"))).alias("repo"), seed.alias("seed"), "fps").select("file_path", "repo", "seed", F.explode("fps").alias("fp"))
    by = p.groupBy("fp", "repo").agg(F.max("seed").alias("seed"))
    known = by.groupBy("fp").agg(F.count("*").alias("n"), F.sum("seed").alias("seeds"), F.max(F.when(F.col("seed") == 1, F.col("repo"))).alias("whose"))
    known = known.where((F.col("n") >= min_repos) | (F.col("seeds") > 0))
    j = p.select("file_path", "repo", "fp").join(known, "fp")
    elsewhere = (F.col("seeds") > 1) | ((F.col("seeds") == 1) & (F.col("whose") != F.col("repo")))
    hits = j.groupBy("file_path").agg(F.count_if(F.col("n") >= min_repos).alias("n_recurring"), F.count_if(elsewhere).alias("n_known"))
    total = evidence.groupBy("file_path").agg(F.sum(F.size("fps")).alias("n_prints"))
    return total.join(hits, "file_path", "left").select("file_path", "n_prints", F.coalesce("n_recurring", F.lit(0)).alias("n_recurring"), F.coalesce("n_known", F.lit(0)).alias("n_known"))


def classify_files(chunks: DataFrame, ignore_patterns: DataFrame | None = None, min_repos: int = MIN_REPOS, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per file with its evidence and ``reason``: copy, third_party, generated, minified, lock, data or null.

    ``ignored`` tells whether a pattern of ``ignore_patterns`` (``*`` first: suffix, otherwise substring) fits the path.
    """
    e = chunk_evidence(chunks)
    # the notes of a file are those of its first chunk, wherever that begins
    opening = F.min_by(F.struct("generated", "third_party", "lock_note"), F.struct("line_start", -F.col("generated"), -F.col("third_party"), -F.col("lock_note"))).alias("o")
    f = e.groupBy("file_path").agg(opening, *(F.sum(k).alias(k) for k in _FIELDS)).select("file_path", "o.*", *_FIELDS)
    f = f.join(recurring_share(e, min_repos), "file_path", "left")
    path = F.col("file_path")
    name = F.element_at(F.split(path, "/"), -1)
    in_dir = in_third_party_folder(path)
    chars, lines = F.greatest("n_chars", F.lit(1)), F.greatest("n_lines", F.lit(1))
    code = F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*CODE)
    minified = (F.col("mini") / chars >= 0.5) | ((F.col("maps") > 0) & (F.col("mini") > 0)) | (name.rlike(r"(?i)[.-]min\.(?:js|mjs|cjs|css)$") & (F.col("mini") > 0)) | name.rlike(r"(?i)\.(?:min|bundle)\.(?:js|mjs|cjs|css)$")
    lock = (F.col("lock_note") > 0) | ((F.col("lock") / lines >= 0.5) & (F.col("n_lines") >= 4) & ~code)
    table = (F.col("table") / lines >= 0.5) & (F.col("n_lines") >= 10) & code
    data = (F.col("data") / chars >= 0.4) & (F.col("n_chars") >= 300) & code
    share = F.greatest("n_recurring", "n_known") / F.greatest("n_prints", F.lit(1))
    by_prints = (F.col("n_prints") >= MIN_PRINTS) & (share >= min_share)
    reason = (
        F.when(in_dir | (F.col("third_party") > 0) & ~minified, "third_party")
        .when(F.col("generated") > 0, "generated")
        .when(minified, "minified")
        .when(lock, "lock")
        .when(data, "data")
        .when(table, "generated")
        .when(by_prints, "copy")
    )
    f = f.withColumns({"by_prints": by_prints, "reason": reason})
    if ignore_patterns is not None:
        pats = ignore_patterns.select(F.trim("pattern").alias("pattern")).where("pattern <> ''").distinct()
        # one row holds all patterns, as an array: the table of patterns is configuration, a few rows
        arr = pats.agg(F.collect_list("pattern").alias("patterns"))
        f = f.join(F.broadcast(arr)).withColumn("ignored", F.exists("patterns", lambda p: F.when(p.startswith("*"), path.endswith(F.substr(p, F.lit(2)))).otherwise(F.contains(path, p)))).drop("patterns")
    return f
