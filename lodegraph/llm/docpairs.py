"""Functions paired with their documentation, taken from source text.

For each family of languages one recursive pattern of the ``regex`` library captures the comment, the signature and the
balanced body together; string literals and comments are tokens of the pattern, so braces, quotes or definitions inside
them mislead nothing. A filter then drops pairs whose documentation says nothing.

Defined results
* null or empty text, and languages without functions: no pair. Texts are read whole.
* a body that the text cuts off ends at the end of the text.
* the same name defined and documented twice in one chunk is two pairs, and one row of ``documented``.
* repeated rows count once, tombstoned rows like others; rows whose id is null are left out.
* the language is taken from the file's extension, else from the language column in any spelling, else nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- languages ---------------------------------------------------------------------------------------------------

FAMILY = {
    "rs": "rust", "rust": "rust", "py": "python", "python": "python", "pyi": "python", "go": "go", "golang": "go",
    "js": "script", "jsx": "script", "mjs": "script", "cjs": "script", "javascript": "script", "ts": "script", "tsx": "script", "typescript": "script",
    "java": "java", "c": "c", "h": "c", "cpp": "c", "cc": "c", "cxx": "c", "hpp": "c", "hh": "c", "c++": "c",
}


def family(path: str | None, language: str | None) -> str | None:
    ext = path.rsplit(".", 1)[-1].strip().lower() if path and "." in path else ""
    return FAMILY.get(ext) or FAMILY.get((language or "").strip().lower())


# --- patterns ----------------------------------------------------------------------------------------------------

_DQ = r'"(?:[^"\\]|\\.)*+"'
_DQ1 = r'"(?:[^"\\\n]|\\.)*+"'
_SQ1 = r"'(?:[^'\\\n]|\\.)*+'"
_TICK = r"`(?:[^`\\]|\\.)*+`"
_RAW_GO = r"`[^`]*+`"
_RUST_CHAR = r"'(?:[^'\\\n]|\\[^\n']{1,10}|\\')'"
_RUST_RAW = r'\bb?r(?P<h>\#*+)"(?s:.*?)"(?P=h)'
_LINE = r"//[^\n]*+"
_BLOCK = r"/\*(?s:.*?)(?:\*/|\Z)"

STRINGS = {
    "rust": f"{_RUST_RAW}|{_DQ}|{_RUST_CHAR}",
    "go": f"{_RAW_GO}|{_DQ1}|{_SQ1}",
    "script": f"{_TICK}|{_DQ1}|{_SQ1}",
    "java": rf'"""(?s:.*?)"""|{_DQ1}|{_SQ1}',
    "c": rf'R"\((?s:.*?)\)"|{_DQ1}|{_SQ1}',
}


def _nest(name: str, a: str, b: str, strings: str) -> str:
    """A balanced pair of brackets; strings and comments inside are tokens. Ends with the text if never closed."""
    return rf"(?P<{name}>\{a}(?:[^{a}{b}\"'`/rbR]++|{strings}|{_LINE}|{_BLOCK}|[/\"'`rbR]|(?&{name}))*+(?:\{b}|\Z))"


#: What a lead is made of, besides blanks: documentation, other comments, attributes or annotations. No blank line within.
_ATTR_RUST = r"\#!?(?P<sq>\[(?:[^\[\]\"]++|\"(?:[^\"\\]|\\.)*+\"|(?&sq))*+\])"
_ANNOT = r"@(?!interface\b)[\w.]++(?:[ \t]*+(?P<ap>\((?:[^()\"']++|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|(?&ap))*+\)))?+"
_NL = r"[ \t\r]*+\n"


def _lead(attr: str | None) -> str:
    item = rf"//[^\n]*+|/\*(?s:.*?)\*/" + (f"|{attr}" if attr else "")
    return rf"(?P<lead>(?:[ \t]*+(?:{item})(?:{_NL}|[ \t]++(?=\S)))++)"


_SIGNATURE = {
    "rust": r"(?:pub(?:[ \t]*\([^)\n]*\))?[ \t]+)?+(?:default[ \t]+)?(?:(?:async|const|unsafe|extern(?:[ \t]+\"[^\"\n]*\")?)[ \t]+)*+fn[ \t]+(?:r\#)?(?P<name>\w++)[ \t]*(?:<[^(]*?>)?[ \t]*(?&par)[^{;]*+(?=(?&body))",
    "go": r"func[ \t]+(?:(?&par)[ \t]*)?(?P<name>\w++)[ \t]*(?:\[[^\]\n]*\])?[ \t]*(?&par)[^{\n]*+(?:interface\{\}|struct\{\}|[^{\n])*?(?=(?&body))",
    "script": r"(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set)[ \t]+)*+(?:function[ \t]*\*?[ \t]*(?P<name>[\w$]++)[ \t]*(?:<[^(]*?>)?[ \t]*(?&par)(?:[ \t]*:[^{;=]*+)?\s*+(?=(?&body))"
    r"|(?:const|let|var)[ \t]+(?P<name>[\w$]++)[ \t]*(?::[^=\n]*?(?:=>[^=\n]*?)?)?=[ \t]*(?:async[ \t]*)?(?:function[ \t]*\*?[ \t]*[\w$]*[ \t]*(?&par)|(?:<[^(]*?>)?[ \t]*(?&par)(?:[ \t]*:[^{;=]*+)?[ \t]*=>|[\w$]++[ \t]*=>)\s*+(?=(?&body)|(?P<expr>[^{\s;][^;\n]*+))"
    r"|\*?[ \t]*(?!(?:if|for|while|switch|catch|return|with|function|new|throw|await|else|do|try|typeof|delete|void)\b)(?P<name>\#?[\w$]++)[ \t]*(?:<[^(\n]*?>)?[ \t]*(?&par)(?:[ \t]*:[^{;=]*+)?\s*+(?=(?&body))"
    r"|(?P<name>\#?[\w$]++)[ \t]*(?::[^=\n]*?)?=[ \t]*(?:async[ \t]*)?(?:function[ \t]*\*?[ \t]*(?&par)|(?&par)(?:[ \t]*:[^{;=]*+)?[ \t]*=>)\s*+(?=(?&body)))",
    "java": r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*+(?:<[^(){};]*?>\s*)?(?!(?:if|for|while|switch|catch|return|new|throw|else|do|try|synchronized)\b)(?:[\w.]++(?:<[^(){};]*?>)?(?:\[\])*\s+(?:@\w+\s+)?)?(?!(?:if|for|while|switch|catch|class|interface|enum|record|new)\b)(?P<name>\w++)\s*(?&par)\s*(?:throws\s[\w.,\s]+?)?(?=(?&body))",
    "c": r"(?:template[ \t]*<[^{};]*?>\s*)?(?!(?:if|for|while|switch|catch|return|new|throw|else|do|typedef|using|namespace|struct|class|enum|union)\b)(?:\[\[[^\]\n]*\]\]\s*)?(?:[\w:]++(?:<[^(){};]*?>)?(?:[ \t]*[*&]+)?\s+[*&]*)*?(?:[\w]++(?:<[^(){};]*?>)?::)*(?!(?:if|for|while|switch|catch|return|sizeof)\b)(?P<name>~?[A-Za-z_]\w*+|operator[^\s(]+)\s*(?&par)(?:\s*(?:const|noexcept|override|final|&{1,2}|->\s*[\w:<>*& ]+))*\s*(?::\s[^{;]*+)?(?=(?&body))",
}

_PATTERN = {}
for _f, _s in STRINGS.items():
    _attr = {"rust": _ATTR_RUST, "java": _ANNOT, "script": _ANNOT, "c": r"\[\[[^\]\n]*\]\]|__attribute__\s*\(\([^)\n]*\)\)"}.get(_f)
    _PATTERN[_f] = regex.compile(
        rf"(?(DEFINE){_nest('par', '(', ')', _s)}{_nest('body', '{', '}', _s)})"
        rf"(?m:^){_lead(_attr)}(?P<sig>[ \t]*+{_SIGNATURE[_f]})|{_BLOCK}|{_LINE}|{_s}"
    )
_BODY = {f: regex.compile(_nest("body", "{", "}", s)) for f, s in STRINGS.items()}

_PY_STR = r"(?i:\b[rbuf]{1,2})?(?:\"\"\"(?s:(?:[^\\]|\\.)*?)(?:\"\"\"|\Z)|'''(?s:(?:[^\\]|\\.)*?)(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+')"
_PY_DOC = r"[rRuU]?(?:\"\"\"(?P<doc>(?s:(?:[^\\]|\\.)*?))\"\"\"|'''(?P<doc>(?s:(?:[^\\]|\\.)*?))'''|\"(?P<doc>(?:[^\"\\\n]|\\.)*+)\"(?!\")|'(?P<doc>(?:[^'\\\n]|\\.)*+)'(?!'))"
_PYTHON = regex.compile(
    rf"(?(DEFINE)(?P<par>\((?:[^()\"'\#]++|{_PY_STR}|\#[^\n]*+|[\"']|(?&par))*+\)))"
    rf"(?m:^)(?P<ind>[ \t]*+)(?P<sig>(?:async[ \t]+)?def[ \t]+(?P<name>\w++)[ \t]*(?:\[[^\]\n]*\])?[ \t]*(?&par)[ \t]*(?:->[^\n:]*(?:\[[^\n]*\])?[^\n:]*)?:)"
    rf"(?=(?:[ \t]*+(?:\#[^\n]*+)?\r?\n)*+[ \t]*+{_PY_DOC}[ \t]*+(?:;|\#|\r?\n|\Z))"
    rf"(?=(?P<body>[^\n]*+(?:\r?\n(?:[ \t]*+(?=\r?\n|\Z)|(?P=ind)[ \t]++(?:[^\"'\#\n]++|{_PY_STR}|\#[^\n]*+|[\"'])*+))*+))"
    rf"|\#[^\n]*+|{_PY_STR}"
)


class Found:
    """A function with its documentation as written; ``start`` and ``end`` span comment, signature and body."""

    __slots__ = ("name", "doc", "code", "start", "end")

    def __init__(self, name: str, doc: str, code: str, start: int, end: int) -> None:
        self.name, self.doc, self.code, self.start, self.end = name, doc, code, start, end


_DOC_ITEM = {
    "rust": regex.compile(r"///(?!/)(?P<t>[^\n]*)|/\*\*(?![*/])(?P<t>(?s:.*?))\*/|\#\[doc\s*=\s*\"(?P<t>(?:[^\"\\]|\\.)*)\"\s*\]|/\*(?s:.*?)\*/|//[^\n]*|\#!?\["),
    "go": regex.compile(r"//(?P<t>[^\n]*)|/\*(?P<t>(?s:.*?))\*/"),
    "script": regex.compile(r"/\*\*(?!/)(?P<t>(?s:.*?))\*/|/\*(?s:.*?)\*/|//[^\n]*"),
    "java": regex.compile(r"/\*\*(?!/)(?P<t>(?s:.*?))\*/|/\*(?s:.*?)\*/|//[^\n]*"),
    "c": regex.compile(r"//[/!]<?(?P<t>[^\n]*)|/\*[*!](?!/)(?P<t>(?s:.*?))\*/|/\*(?s:.*?)\*/|//[^\n]*"),
}
_STAR = regex.compile(r"(?m)^[ \t]*\*+(?!/)[ \t]?")


def _doc_of(fam: str, lead: str) -> str:
    """The text of the documentation in a lead; of block comments, the last one."""
    lines: list[str] = []
    for m in _DOC_ITEM[fam].finditer(lead):
        t = m["t"]
        if t is None:
            continue
        if m[0].startswith("/*"):
            lines = [_STAR.sub("", t.strip("*! \t"))]
        else:
            lines.append(t.replace('\\"', '"'))
    return "\n".join(lines)


def functions(text: str | None, fam: str | None) -> Iterator[Found]:
    """All functions and methods in ``text`` that have a documentation comment, trivial ones included."""
    if not text or fam is None:
        return
    if fam == "python":
        if "def" not in text:
            return
        for m in _PYTHON.finditer(text):
            if m["name"] is not None:
                yield Found(m["name"], m["doc"] or "", m["ind"] + m["sig"] + m["body"], m.start(), m.end("body"))
        return
    for m in _PATTERN[fam].finditer(text):
        name = m["name"]
        if name is None:
            continue
        doc = _doc_of(fam, m["lead"])
        if not doc.strip():
            continue
        b = _BODY[fam].match(text, m.end())
        end = b.end() if b else (m.end("expr") if fam == "script" and m["expr"] else m.end())
        yield Found(name, doc, m["sig"].strip() + text[m.end() : end], m.start(), end)


# --- the filter --------------------------------------------------------------------------------------------------

_TAG = regex.compile(r"^[@\\:](?P<tag>[A-Za-z]+)(?:\[[^\]]*\])?[:\s]*(?P<rest>.*)$")
_WITH_NAME = frozenset("param arg argument property prop tparam typeparam template throws exception raises type var cvar ivar key keyword".split())
_TEXT_TAGS = frozenset("brief details summary description desc short note remark remarks return returns result".split())
_PY_ITEM = regex.compile(r"^\*{0,2}[A-Za-z_]\w*(?:[ \t]*\([^)]*\))?[ \t]*:(?P<rest>.*)$")
_HEADING = regex.compile(r"(?i)^(?:args?|arguments|parameters?|params?|returns?|yields?|raises|throws|examples?|notes?|attributes|see also|safety|panics|errors|type parameters)\s*:?$|^#+\s*(?:arguments|returns|safety|panics|errors|examples?)\s*$")
_PLACEHOLDER = regex.compile(
    r"(?i)^[(\[{<]*(?:(?:todo|fixme|xxx|tbd|tba|hack|wip)\b.*|n/?a|none|null|nil|undocumented|internal(?:\s+use(?:\s+only)?)?|private|deprecated|stub|description|documentation|docs?|summary|comment|placeholder|(?:no|missing|add|insert|write|needs?)\s+(?:a\s+)?(?:description|docs?|documentation|comment|summary)(?:\s+(?:here|yet|available|provided|needed))*|auto[\s-]?generated(?:\s+(?:method|function|constructor))?(?:\s+(?:stub|code|comment|docs?|documentation))?|generated(?:\s+(?:stub|code|method))?|to\s+be\s+(?:documented|written|done|filled(?:\s+in)?)|document\s+(?:me|this)|self[\s-]explanatory|blah.*|foo|bar|test)[)\]}>.!:]*$"
)
_DIRECTIVE = regex.compile(
    r"(?i)^(?:nolint|noqa|no-?lint|nosec|noinspection|eslint|tslint|jslint|jshint|stylelint|prettier-ignore|istanbul|c8\s+ignore|v8\s+ignore|webpack\w*:|@ts-\w+|ts-(?:ignore|expect|nocheck)|@flow|@jsx|pylint\s*:|flake8\s*:|mypy\s*:|type\s*:\s*ignore|pragma\b|fmt\s*:|yapf\s*:|isort\s*:|ruff\s*:|pyright\s*:|rustfmt|clippy|clang-(?:format|tidy)|cppcheck|coverity|go:\w+|\+build|lint:|exported\s|line\s+\S+:\d+|region\b|endregion\b|codespell|spell-?checker|cspell|sonar|checkstyle|spotless|@formatter|@suppress|language=|vim?:|-\*-|gocyclo|gosec|revive:|coverage\s*:|lcov|kcov)\S*"
)
_XREF = regex.compile(r"(?i)^(?:(?:please\s+)?(?:see|cf\.?|refer\s+to|compare|consult)\b(?:\s+(?:also|above|below|the|its|base|parent|docs?|documentation|of|for|details|more|information|there|header|interface|class|overview|comment))*(?:\s*\{@\w+\s[^}]*\}|[\s{(\[`@]*[\w.:#/()`{}@\]\[-]*)(?:\s+(?:for|in|above|below|and)\b.*)?|same\s+as\b.*|ditto|as\s+(?:above|below)|\{@?\s*inheritdoc\}?|@?inheritdoc|\{@(?:link|see)[^}]*\}|inherited(?:\s+(?:docs?|documentation|from\b.*))?|overrides?\s+\S+|implements?\s+\S+)[.!]*$")
_CODE = regex.compile(
    r"[;{}]\s*$|^[\w.\[\]>-]+(?:::\w+)*\s*\([^)]*\)\s*;?$|^(?:let|var|const|return|if|for|while|else|import|use|self|def|func|fn|raise|throw|yield|await|break|continue|pass)\b.*[=(){}\[\]:<>].*$|^[\w.\[\]]+(?:,\s*[\w.]+)*\s*(?:[-+*/|&%]?=|:=|<-)\s*\S.*$|^[\w.]+\.\w+\([^)]*\)\.?$|^(?:>>>|\$ )|^}|^{|^\w+!\(.*\)"
)
_WORD = regex.compile(r"\p{L}[\p{L}\p{N}']*")
_SPLIT = regex.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|_+|(?<=\D)(?=\d)")
_STOP = frozenset(
    "a an the this that these those of to for in on at by with from and or is are be it its as given function method fn func procedure routine helper handler implementation implements "
    "does do performs perform returns return value values object instance provided new all one simply just code here we you used".split()
)


def _stem(w: str) -> str:
    w = w.lower().strip("'")
    if w.endswith("'s"):
        w = w[:-2]
    for s, least in (("ies", 2), ("ing", 3), ("ed", 3), ("es", 3), ("s", 3), ("er", 4), ("or", 4)):
        if w.endswith(s) and len(w) - len(s) >= least:
            w = w[: -len(s)] + ("y" if s == "ies" else "")
            break
    w = w.rstrip("e")
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def says_something(doc: str, name: str) -> bool:
    """Is the documentation more than empty, placeholder, marker, ruler, directive, bare tags, the name again, a reference or code?"""
    known = {_stem(w) for w in _SPLIT.split(name) if w} | {_stem(name)}
    content: list[str] = []
    for raw in doc.replace("\r", "").split("\n"):
        line = raw.strip().strip("*").strip()
        if not line or not regex.search(r"\p{L}", line):
            continue
        line = regex.sub(r"^(?:///?!?|//!|#+(?=\s)|;+|--\s)\s*", "", line).strip()
        if _DIRECTIVE.match(line) or _HEADING.match(line):
            continue
        t = _TAG.match(line)
        if t:
            tag, line = t["tag"].lower(), t["rest"].strip()
            if tag in ("see", "link", "inheritdoc", "internal", "private", "public", "override", "todo", "fixme", "ignore", "hidden", "deprecated", "since", "author", "version", "file", "copyright", "license", "ingroup", "name", "fn", "function", "method", "class", "memberof", "async", "export"):
                continue
            if tag in _WITH_NAME:
                line = regex.sub(r"^(?:\{[^}]*\}\s*)?\[?[\w$.*&]+\]?\s*[-:]?\s*", "", line)
            elif tag in _TEXT_TAGS:
                line = regex.sub(r"^\{[^}]*\}\s*", "", line)
            if not line:
                continue
        else:
            p = _PY_ITEM.match(line)
            if p and len(line.split(":")[0].split()) == 1 and not p["rest"].startswith((":", "=")):
                line = p["rest"].strip() or ""
                if not line:
                    continue
        if _PLACEHOLDER.match(line) or _DIRECTIVE.match(line) or _XREF.match(line) or _CODE.search(line):
            continue
        content += _WORD.findall(line)
    new = [w for w in content if w.lower() not in _STOP and _stem(w) not in known and not all(_stem(x) in known for x in _SPLIT.split(w) if x)]
    return len(new) >= 2


# --- DataFrame operators -----------------------------------------------------------------------------------------


def _pairs_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, path, lang, text in zip(b["chunk_id"], b["path"], b["language"], b["text"]):
            for f in functions(text, family(path, lang)):
                if says_something(f.doc, f.name):
                    rows.append((i, f.name, f.start, f.end, f.doc.strip(), f.code))
        if rows:
            yield pd.DataFrame(rows, columns=["chunk_id", "name", "start", "end", "doc", "code"])


def _names_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _pairs_batches(batches):
        yield b[["chunk_id", "name"]].drop_duplicates()


def _input(chunks: DataFrame, types: tuple[str, ...]) -> DataFrame:
    d = chunks.where(F.lower(F.trim("chunk_type")).isin(*types) & F.col("id").isNotNull() & (F.length("content") > 0))
    return d.select(F.col("id").cast("long").alias("chunk_id"), F.col("file_path").alias("path"), F.col("language").alias("language"), F.col("content").alias("text"))


TYPES = ("function", "method", "module")


def doc_pairs(chunks: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """(chunk_id, name, start, end, doc, code): each documented function with its code, character offsets in the chunk."""
    return _input(chunks, types).mapInPandas(_pairs_batches, "chunk_id long, name string, start int, end int, doc string, code string")


def documented(chunks: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """(chunk_id, name) of the same pairs, each once; only names cross from the Python workers to the shuffle."""
    return _input(chunks, types).mapInPandas(_names_batches, "chunk_id long, name string").distinct()
