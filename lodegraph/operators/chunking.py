"""Chunking files (path, language, content): line windows, Markdown sections, paragraphs, and syntactic blocks of code.

The text rules are native expressions. Blocks of code come from a plug-in scanner by language in an Arrow-fed Python
function: the standard parser for Python, a brace scanner for the others. A scanner is any function text -> blocks.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.languages import CODE_LANGUAGES
from ..functions.text import lines
from ..session import cut

WINDOW, STEP, MIN_WORDS = 40, 30, 3
COLUMNS = "path string, language string, chunk_type string, line_start int, line_end int, content string"


def words(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def _windows(ls: Column, window: int = WINDOW, step: int = STEP) -> Column:
    """The windows of an array of lines, as an array of (line_start, line_end, content); those of few words are left out."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(ls) - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s + (window - step) < F.size(ls)))
    every = F.transform(starts, lambda s: F.struct((s + 1).alias("line_start"), F.least(s + window, F.size(ls)).alias("line_end"), F.array_join(F.slice(ls, s + 1, F.lit(window)), "\n").alias("content")))
    return F.filter(every, lambda w: words(w["content"]) >= MIN_WORDS)


def line_windows(files: DataFrame, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """Windows of ``window`` lines every ``step`` lines; the one that reaches the end is the last. Windows of few words are left out."""
    d = files.select("path", "language", lines(F.col("content")).alias("ls")).where(F.size("ls") > 0)
    d = d.select("path", "language", F.explode(_windows(F.col("ls"), window, step)).alias("w"))
    return d.select("path", "language", F.lit("Module").alias("chunk_type"), "w.line_start", "w.line_end", "w.content")


def markdown_sections(files: DataFrame) -> DataFrame:
    """A section from each line that begins with #, and what stands before the first; nothing is too short.

    Sections are cut within each file's array of lines, so a long file is not spread over rows and gathered again.
    """
    d = files.select("path", "language", lines(F.col("content")).alias("ls")).where(F.size("ls") > 0)
    heads = F.filter(F.transform("ls", lambda x, i: F.when(x.startswith("#") | (i == 0), i)), lambda i: i.isNotNull())
    d = d.select("path", "language", "ls", heads.alias("heads"))
    ends = F.concat(F.slice("heads", 2, F.greatest(F.size("heads") - 1, F.lit(0))), F.array(F.size("ls")))
    d = d.select("path", "language", "ls", F.explode(F.arrays_zip(F.col("heads").alias("a"), ends.alias("b"))).alias("p"))
    text = F.array_join(F.slice("ls", F.col("p.a") + 1, F.col("p.b") - F.col("p.a")), "\n")
    return d.select("path", "language", F.lit("Section").alias("chunk_type"), (F.col("p.a") + 1).alias("line_start"), F.col("p.b").cast("int").alias("line_end"), text.alias("content")).where(F.trim("content") != "")


def paragraphs(files: DataFrame) -> DataFrame:
    """Paragraphs between blank lines, of three words or more. Line numbers follow the parts' own lines and one blank line between."""
    d = files.select("path", "language", F.split("content", "\n\n").alias("ps"))
    counts = F.transform("ps", lambda p: F.size(lines(p)))
    d = d.select("path", "language", "ps", counts.alias("n"))
    # the running line number: lines of the parts before, and one for each break
    starts = F.transform("ps", lambda p, i: F.aggregate(F.slice("n", 1, i), F.lit(1), lambda a, x: a + x + 1))
    z = F.arrays_zip(F.col("ps").alias("p"), F.col("n").alias("n"), starts.alias("s"))
    d = d.select("path", "language", F.explode(z).alias("z"))
    d = d.select("path", "language", F.lit("Paragraph").alias("chunk_type"), F.col("z.s").alias("line_start"), (F.col("z.s") + F.col("z.n") - 1).alias("line_end"), F.trim(F.col("z.p")).alias("content"))
    return d.where(words(F.col("content")) >= MIN_WORDS)


# --- code blocks -------------------------------------------------------------------------------------------------

Block = tuple[str, int, int]  # chunk type, first and last line, from 1

#: What begins a block, by language: (pattern of a line, chunk type, are its methods blocks too?).
_STARTS: dict[str, list[tuple[re.Pattern, str, bool]]] = {
    "rs": [(re.compile(r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|const|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+\w"), "Function", False), (re.compile(r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union)\s+\w"), "Class", True), (re.compile(r"\s*(?:unsafe\s+)?impl\b"), "Class", True), (re.compile(r"\s*macro_rules!\s*\w"), "Function", False)],
    "go": [(re.compile(r"func\s+\(\w*\s*\*?[\w.\[\]]+\)\s*\w"), "Method", False), (re.compile(r"func\s+\w"), "Function", False), (re.compile(r"type\s+\w"), "Class", False)],
    "ts": [(re.compile(r"\s*export\s+(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:function|class|const|let|var|interface|enum)\b"), "Module", False), (re.compile(r"\s*(?:async\s+)?function\b"), "Function", False), (re.compile(r"\s*(?:abstract\s+)?class\s+\w"), "Class", True), (re.compile(r"\s*(?:const|let|var)\s+\w+[^=]*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)[^=\n]*=>"), "Function", False)],
}
_STARTS["js"] = _STARTS["ts"]
_METHOD = re.compile(r"\s+(?:(?:public|private|protected|static|readonly|async|get|set|override)\s+)*(?!(?:if|for|while|switch|catch|return|function|new|else|do)\b)[\w$#]+\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^{;]*)?\{")
_RUST_METHOD = _STARTS["rs"][0][0]


def _block_end(ls: list[str], at: int, rust: bool) -> int:
    """The last line of the block that starts at line ``at``: its braces close, or a semicolon comes before any opens."""
    depth, seen, quote, comment = 0, False, "", False
    for n in range(at, len(ls)):
        i, s = 0, ls[n]
        while i < len(s):
            c = s[i]
            if comment:
                if s.startswith("*/", i):
                    comment, i = False, i + 1
            elif quote:
                if c == "\\":
                    i += 1
                elif c == quote:
                    quote = ""
            elif s.startswith("//", i):
                break
            elif s.startswith("/*", i):
                comment, i = True, i + 1
            elif c == '"' or c == "`" or c == "'" and (not rust or re.match(r"'(?:\\.|[^\\'])'", s[i:])):
                quote = c
            elif c == "{":
                depth, seen = depth + 1, True
            elif c == "}":
                depth -= 1
                if seen and depth <= 0:
                    return n
            elif c == ";" and not seen and depth == 0:
                return n
            i += 1
        if quote in ("'", '"') and not rust:
            quote = ""
    return len(ls) - 1


def _scan(text: str, lang: str) -> list[Block]:
    ls = text.split("\n")
    out: list[Block] = []

    def walk(lo: int, hi: int, inside: bool) -> None:
        n = lo
        while n <= hi:
            for pattern, kind, deeper in _STARTS[lang]:
                if pattern.match(ls[n]):
                    if kind == "Function" and inside and lang in ("ts", "js"):
                        continue
                    end = min(_block_end(ls, n, lang == "rs"), hi)
                    out.append((kind, n + 1, end + 1))
                    if deeper:
                        walk(n + 1, end - 1, True)
                    n = end
                    break
            else:
                if inside and lang in ("ts", "js") and _METHOD.match(ls[n]):
                    end = min(_block_end(ls, n, False), hi)
                    out.append(("Method", n + 1, end + 1))
                    n = end
            n += 1

    walk(0, len(ls) - 1, False)
    return out


def _python(text: str) -> list[Block]:
    out: list[Block] = []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return out

    def walk(body: list[ast.stmt]) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(("Function", node.lineno, node.end_lineno or node.lineno))
            elif isinstance(node, ast.ClassDef):
                out.append(("Class", node.lineno, node.end_lineno or node.lineno))
                walk(node.body)
            else:
                for part in ("body", "orelse", "finalbody"):
                    walk([x for x in getattr(node, part, []) if isinstance(x, ast.stmt)])

    walk(tree.body)
    return out


SCANNERS: dict[str, Callable[[str], list[Block]]] = {"py": _python, **{x: (lambda t, x=x: _scan(t, x)) for x in ("rs", "go", "ts", "js")}}


def blocks_of(text: str, language: str, scanners=None) -> list[tuple[str, int, int, str]]:
    """Blocks of a file with their text; those of fewer than three words are left out."""
    scan = (scanners or SCANNERS).get(language)
    if scan is None or not text:
        return []
    ls = text.replace("\r\n", "\n").split("\n")
    out = []
    for kind, a, b in scan(text.replace("\r\n", "\n")):
        t = "\n".join(ls[a - 1 : b]).strip()
        if len(t.split()) >= MIN_WORDS:
            out.append((kind, a, b, t))
    return out


def code_blocks(files: DataFrame, scanners=None, rest: bool = False) -> DataFrame:
    """Syntactic blocks: functions, methods, classes (whose methods are blocks too), exports. With ``rest``, a file in
    which none is found comes out whole, with no chunk_type."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, lang, t in zip(b["path"], b["language"], b["content"]):
                got = blocks_of(t, lang, scanners)
                rows += [(p, lang, *x) for x in got]
                if rest and not got:
                    rows.append((p, lang, None, None, None, t))
            if rows:
                yield pd.DataFrame(rows, columns=["path", "language", "chunk_type", "line_start", "line_end", "content"]).astype({"line_start": "Int32", "line_end": "Int32"})

    return files.select("path", "language", "content").mapInPandas(read, COLUMNS)


def chunk_files(files: DataFrame, scanners=None) -> DataFrame:
    """All rules by language: blocks of code; windows where a language has no scanner or a file no block; one chunk for a
    file that is left with nothing but isn't blank; sections of Markdown; paragraphs of everything else.

    Each file is parsed once; what the scanners leave is written once to the shared folder with their blocks.
    """
    f = files.where(F.length(F.trim("content")) > 0)
    with_scanner = list(scanners or SCANNERS)
    code = f.where(F.col("language").isin(*CODE_LANGUAGES))
    scanned = F.col("language").isin(*with_scanner)
    parsed = cut(code_blocks(code.where(scanned), scanners, rest=True))
    rest = parsed.where("chunk_type is null").select("path", "language", "content").unionByName(code.where(~scanned).select("path", "language", "content"))
    ls = lines(F.col("content"))
    ws = rest.select("path", "language", F.size(ls).alias("n"), _windows(ls).alias("ws"), F.trim("content").alias("content"))
    # a file whose windows all have too few words is one chunk
    whole = F.array(F.struct(F.lit(1).alias("line_start"), F.col("n").alias("line_end"), F.col("content").alias("content")))
    windows = ws.select("path", "language", F.explode(F.when(F.size("ws") > 0, F.col("ws")).otherwise(whole)).alias("w"))
    windows = windows.select("path", "language", F.lit("Module").alias("chunk_type"), "w.line_start", "w.line_end", "w.content")
    prose = f.where(~F.col("language").isin(*CODE_LANGUAGES))
    out = parsed.where("chunk_type is not null")
    for p in (windows, markdown_sections(prose.where("language = 'md'")), paragraphs(prose.where("language <> 'md'"))):
        out = out.unionByName(p)
    return out


def with_ids(chunks: DataFrame) -> DataFrame:
    """Stable ids from place and content: the same under replay, and no global numbering."""
    h = F.xxhash64("path", "line_start", "line_end", "chunk_type", "content")
    return chunks.withColumns({"id": h, "content_hash": F.xxhash64("content"), "token_count": words(F.col("content"))})


def numbered(chunks: DataFrame) -> DataFrame:
    """Ids 0, 1, 2… by path, line and type, without one global window: counts by range partition give each its offset."""
    keys = ["path", "line_start", "line_end", "chunk_type", "content"]
    s = chunks.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("part").orderBy(*keys)
    s = s.withColumn("n", F.row_number().over(w))
    offsets = s.groupBy("part").agg(F.count("*").alias("c"))
    offsets = offsets.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    return s.join(F.broadcast(offsets), "part").withColumn("id", F.col("o") + F.col("n") - 1).drop("part", "n", "o")
