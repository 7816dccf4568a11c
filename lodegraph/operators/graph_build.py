"""Building the code graph from files (path, language, content): nodes, and edges contains, imports, calls.

One Python pass reads each file once and gives its definitions, imports and calls; everything after it (names, routes,
resolution) is joins. Extractors are plug-ins by language: text -> facts.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .chunking import _block_end
from .graph_analytics import bare

# Names so common that a call across files says nothing.
COMMON_CALLS = (
    "as_mut as_ref as_str clone close collect contains default drop err expect filter fmt from get init insert into into_iter is_empty iter iter_mut len lock map new next now ok open parse peek "
    "pop push read recv remove send set spawn to_string unlock unwrap write"
).split()
HTTP = ("get", "post", "put", "delete", "patch", "head", "options")

#: A fact: (what, kind, name, owner, line_start, line_end, detail). what: def, call (name calls detail), import (name).
Fact = tuple[str, str, str, str, int, int, str | None]
FACTS = "path string, language string, what string, kind string, name string, line_start int, line_end int, detail string, owner string"


def _python_facts(text: str) -> list[Fact]:
    out: list[Fact] = []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return out

    def endpoint(node) -> str | None:
        kind = None
        for d in node.decorator_list:
            f = d.func if isinstance(d, ast.Call) else d
            if isinstance(f, ast.Attribute) and isinstance(d, ast.Call):
                kind = f.attr.upper() if f.attr in HTTP else "ROUTE" if f.attr == "route" else kind
        return kind

    def calls(node) -> list[str]:
        names = {(c.func.id if isinstance(c.func, ast.Name) else c.func.attr) for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute))}
        return sorted(names)

    def walk(body, owner: str) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                route = endpoint(n)
                kind = "endpoint" if route else "method" if owner else "function"
                out.append(("def", kind, n.name, owner, n.lineno, n.end_lineno or n.lineno, route))
                out.extend(("call", "", n.name, owner, n.lineno, n.lineno, c) for c in calls(n))
            elif isinstance(n, ast.ClassDef):
                out.append(("def", "class", n.name, "", n.lineno, n.end_lineno or n.lineno, None))
                walk(n.body, n.name)
            elif isinstance(n, (ast.If, ast.Try, ast.With)):
                walk(n.body, owner)

    walk(tree.body, "")
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            out.extend(("import", "", a.name.split(".")[0], "", n.lineno, n.lineno, None) for a in n.names)
        elif isinstance(n, ast.ImportFrom):
            first = (n.module or (n.names[0].name if n.names else "")).split(".")[0]
            if first:
                out.append(("import", "", first, "", n.lineno, n.lineno, None))
    return out


_CALL = re.compile(r"(?<![\w.])(?:[\w]+(?:::|\.))*([A-Za-z_]\w*)\s*(?:::<[^>]*>)?\(")
_NOT_CALLS = frozenset("if for while switch match return catch sizeof new super await typeof function fn func def else do loop in assert".split())
_DEFS: dict[str, list[tuple[re.Pattern, str]]] = {
    "rs": [
        (re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|const|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(?P<name>\w+)"), "function"),
        (re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)"), "struct"),
        (re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)"), "class"),
        (re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(?P<name>\w+)"), "trait"),
        (re.compile(r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>\w+)"), "impl"),
    ],
    "go": [(re.compile(r"^func\s+\(\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*(?P<name>\w+)"), "method"), (re.compile(r"^func\s+(?P<name>\w+)"), "function"), (re.compile(r"^type\s+(?P<name>\w+)"), "struct")],
    "ts": [
        (re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)"), "class"),
        (re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)"), "function"),
        (re.compile(r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)[^=\n]*=\s*(?:async\s*)?(?:function\b|\([^)]*\)[^=\n]*=>|\w+\s*=>)"), "function"),
    ],
    "java": [
        (re.compile(r"^\s*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(?:class|record)\s+(?P<name>\w+)"), "class"),
        (re.compile(r"^\s*(?:(?:public|private|protected|static|sealed)\s+)*interface\s+(?P<name>\w+)"), "trait"),
        (re.compile(r"^\s*(?:(?:public|private|protected|static)\s+)*enum\s+(?P<name>\w+)"), "struct"),
    ],
    "c": [(re.compile(r"^\s*(?:typedef\s+)?struct\s+(?P<name>\w+)\s*\{"), "struct"), (re.compile(r"^\s*class\s+(?P<name>\w+)[^;]*\{?\s*$"), "class"), (re.compile(r"^(?!\s*(?:if|for|while|switch|return|else|do|typedef|using)\b)[\w:<>,*&~\s]+?(?:\w+::)?(?P<name>~?\w+)\s*\([^;]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{?\s*$"), "function")],
}
_DEFS["js"], _DEFS["cpp"] = _DEFS["ts"], _DEFS["c"]
_MEMBERS = {
    "ts": re.compile(r"^\s+(?:(?:public|private|protected|static|readonly|async|get|set|override)\s+)*(?!(?:if|for|while|switch|catch|return|function|new|else|do)\b)(?P<name>[\w$#]+)\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^{;]*)?\{"),
    "java": re.compile(r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)*(?:<[^>]+>\s*)?(?:(?P<type>[\w.<>\[\], ]+?)\s+)?(?!(?:if|for|while|switch|catch|return|new|else|do)\b)(?P<name>\w+)\s*\([^;]*\)\s*(?:throws [\w., ]+)?\{?\s*$"),
}
_MEMBERS["js"] = _MEMBERS["ts"]
_TS_ROUTE = re.compile(r"\b\w+\.(get|post|put|delete|patch)\(\s*[\"'`]([^\"'`]*)[\"'`]")
_TS_IMPORT = re.compile(r"(?:\bfrom\s*|\brequire\(\s*|\bimport\s+)[\"'](\.[^\"']*)[\"']")
_RS_MOD = re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;")
_JAVA_ROUTE = re.compile(r"@(Get|Post|Put|Delete|Patch|Request)Mapping\b")
_AXUM = re.compile(r"\b(?:get|post|put|delete|patch|any)\(\s*(?:\w+::)*(\w{3,})\s*\)")
_EXPRESS = re.compile(r"\.(?:get|post|put|delete|patch|use)\(\s*[\"'][^\"']*[\"']\s*,\s*(?:[\w.]+\s*,\s*)*(?:\w+\.)*(\w{3,})\s*\)")


def _scanned_facts(text: str, lang: str) -> list[Fact]:
    ls = text.split("\n")
    out: list[Fact] = []
    rust = lang == "rs"

    def body_calls(name: str, owner: str, a: int, b: int) -> None:
        if lang == "go":
            return  # calls of this language are not followed
        found = {m for ln in ls[a : b + 1] for m in _CALL.findall(ln.split("//")[0])} - _NOT_CALLS
        out.extend(("call", "", name, owner, a + 1, a + 1, c) for c in sorted(found))

    def walk(lo: int, hi: int, owner: str) -> None:
        n = lo
        while n <= hi:
            for pattern, kind in _DEFS[lang]:
                m = pattern.match(ls[n])
                if not m or (owner and not rust and kind == "function"):
                    continue
                name = m["name"]
                end = min(_block_end(ls, n, rust), hi)
                if kind == "impl":
                    walk(n + 1, end - 1, name)
                elif kind in ("class", "struct", "trait"):
                    out.append(("def", kind, name, "", n + 1, end + 1, "enum" if rust and kind == "class" else None))
                    if lang in _MEMBERS or lang == "cpp":
                        walk(n + 1, end - 1, name)
                else:
                    own = m.groupdict().get("owner") or owner
                    full = f"{own}::{name}" if rust and own else name
                    out.append(("def", "method" if own else kind, full, own, n + 1, end + 1, None))
                    body_calls(full, own, n, end)
                n = end
                break
            else:
                m = _MEMBERS[lang].match(ls[n]) if owner and lang in _MEMBERS else None
                if m and m["name"] != "constructor":
                    end = min(_block_end(ls, n, False), hi)
                    route = _JAVA_ROUTE.search("\n".join(ls[max(0, n - 3) : n + 1])) if lang == "java" else None
                    kind = "endpoint" if route else "function" if lang == "java" and m["name"] == owner else "method"
                    out.append(("def", kind, m["name"], owner, n + 1, end + 1, route[1].upper() if route else None))
                    body_calls(m["name"], owner, n, end)
                    n = end
            n += 1

    walk(0, len(ls) - 1, "")
    for n, ln in enumerate(ls, 1):
        if lang in ("ts", "js"):
            out.extend(("def", "endpoint", f"{m[1].upper()} {m[2]}", "", n, n, m[1].upper()) for m in _TS_ROUTE.finditer(ln))
            out.extend(("import", "", p, "", n, n, None) for p in _TS_IMPORT.findall(ln))
            out.extend(("route", "", h, "", n, n, None) for h in _EXPRESS.findall(ln))
        elif rust:
            out.extend(("import", "", p, "", n, n, None) for p in _RS_MOD.findall(ln))
            if ".route(" in ln or "route!(" in ln:
                out.extend(("route", "", h, "", n, n, None) for h in _AXUM.findall(ln))
    return out


EXTRACTORS: dict[str, Callable[[str], list[Fact]]] = {"py": _python_facts, **{x: (lambda t, x=x: _scanned_facts(t, x)) for x in ("rs", "go", "ts", "js", "java", "c", "cpp")}}


def facts(files: DataFrame, extractors=None) -> DataFrame:
    """Definitions, imports, calls and routes of every file, in one pass; written to the shared folder, for several joins read it."""
    ex = extractors or EXTRACTORS

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, lang, t in zip(b["path"], b["language"], b["content"]):
                f = ex.get(lang)
                for what, kind, name, owner, a, z, detail in f(t.replace("\r\n", "\n")) if f and t else ():
                    rows.append((p, lang, what, kind, name, a, z, detail, owner))
            if rows:
                yield pd.DataFrame(rows, columns=["path", "language", "what", "kind", "name", "line_start", "line_end", "detail", "owner"])

    return cut(files.select("path", "language", "content").mapInPandas(read, FACTS).distinct())


def node_id(*cols) -> object:
    """An id from what identifies a node: stable under replay, no global numbering."""
    return F.xxhash64(*cols)


def build_graph(files: DataFrame, extractors=None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all files."""
    f = files.where("path is not null").dropDuplicates(["path"])
    fact = facts(f, extractors)
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    modules = f.select(node_id(F.lit("module"), F.col("path")).alias("id"), stem.alias("name"), F.lit("module").alias("kind"), F.col("path").alias("file_path"), F.lit(1).alias("line_start"), F.greatest(F.size(F.split("content", "\n")), F.lit(1)).alias("line_end"), "language", F.lit(None).cast("string").alias("detail"))
    d = fact.where("what = 'def'")
    defs = d.select(node_id("kind", "path", "name", "line_start").alias("id"), "name", "kind", F.col("path").alias("file_path"), "line_start", "line_end", "language", "detail").dropDuplicates(["id"])
    # handlers named in route lines become endpoints: in their own file, or where the name is unique
    routed = fact.where("what = 'route'").select(F.col("path").alias("r_path"), F.col("name").alias("bare")).distinct()
    n = defs.withColumn("bare", bare(F.col("name")))
    times = n.groupBy("bare").agg(F.count("*").alias("times"))
    hit = n.join(routed, "bare").join(times, "bare").where((F.col("file_path") == F.col("r_path")) | (F.col("times") == 1)).select("id").distinct().withColumn("routed", F.lit(True))
    defs = defs.join(hit, "id", "left").withColumn("kind", F.when(F.col("routed"), "endpoint").otherwise(F.col("kind"))).drop("routed")
    nodes = cut(modules.unionByName(defs))
    module = nodes.where("kind = 'module'").select(F.col("id").alias("module"), "file_path")
    rest = nodes.where("kind <> 'module'")
    contains = rest.join(module, "file_path").select(F.col("module").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind"))
    edges = contains.unionByName(resolve_imports(fact, nodes)).unionByName(resolve_calls(fact, nodes))
    return nodes, edges.distinct()


def resolve_imports(fact: DataFrame, nodes: DataFrame) -> DataFrame:
    """Imports as edges between modules: a relative path by its candidates, else the last segment against file stems."""
    modules = nodes.where("kind = 'module'").select("id", "file_path", F.lower("name").alias("stem"))
    imp = fact.where("what = 'import'").select("path", "name").join(modules.select(F.col("file_path").alias("path"), F.col("id").alias("src")), "path")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    base = F.concat(folder, F.lit("/"), F.regexp_replace("name", r"^\./", ""))
    ends = [".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    relative = imp.where(F.col("name").startswith(".")).select("src", F.posexplode(F.array(*(F.concat(base, F.lit(e)) for e in ends))).alias("pos", "file_path"), "name")
    r = relative.join(modules.select("file_path", F.col("id").alias("dst")), "file_path").groupBy("src", "name").agg(F.min_by("dst", "pos").alias("dst"))
    plain = imp.where(~F.col("name").startswith(".")).select("src", "name", F.lower(F.element_at(F.split("name", r"\."), -1)).alias("stem"))
    p = plain.join(modules.groupBy("stem").agg(F.min("id").alias("dst")), "stem").select("src", "name", "dst")
    return r.unionByName(p).where("src <> dst").select("src", "dst", F.lit("imports").alias("kind"))


def resolve_calls(fact: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls as edges: to the only node of that name, unless it is a common name in another file; of several, to the one in
    the same file. The caller is the first node of its name in its file."""
    n = nodes.where("kind <> 'module'").select("id", "file_path", "name", "line_start")
    caller = n.groupBy(F.col("file_path").alias("path"), F.col("name").alias("caller")).agg(F.min_by("id", "line_start").alias("src"))
    c = fact.where("what = 'call'").select("path", F.col("name").alias("caller"), F.col("detail").alias("callee")).where(bare(F.col("caller")) != F.col("callee")).distinct().join(caller, ["path", "caller"])
    index = n.select(F.explode(F.array_distinct(F.array("name", bare(F.col("name"))))).alias("callee"), "id", "file_path", "line_start")
    known = index.groupBy("callee").agg(F.count("*").alias("times"), F.min("id").alias("only"), F.min("file_path").alias("only_path"))
    local = index.groupBy("callee", F.col("file_path").alias("path")).agg(F.min_by("id", "line_start").alias("near"))
    j = c.join(known, "callee").join(local, ["callee", "path"], "left")
    unique = F.when((F.col("only_path") == F.col("path")) | ~F.col("callee").isin(*COMMON_CALLS), F.col("only"))
    dst = F.when(F.col("times") == 1, unique).otherwise(F.col("near"))
    return j.select("src", dst.alias("dst"), F.lit("calls").alias("kind")).where("dst is not null and src <> dst")
