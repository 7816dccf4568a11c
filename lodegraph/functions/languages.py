"""Languages by file extension and by alias, and the ignore predicate for paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by language, as the formats define them.
EXTENSIONS = {
    "rs": ("rs",), "ts": ("ts", "tsx"), "js": ("js", "jsx", "mjs"), "py": ("py",), "go": ("go",), "java": ("java",), "c": ("c", "h"), "cpp": ("cpp", "cc", "cxx", "hpp"),
    "md": ("md", "markdown"), "toml": ("toml",), "yaml": ("yaml", "yml"), "json": ("json",), "txt": ("txt",), "sh": ("sh", "bash"), "dockerfile": ("dockerfile",), "pdf": ("pdf",),
}
# Names a user may give for a language.
ALIASES = {
    "rust": "rs", "rs": "rs", "typescript": "ts", "ts": "ts", "javascript": "js", "js": "js", "python": "py", "py": "py", "golang": "go", "go": "go", "java": "java", "c": "c",
    "c++": "cpp", "cpp": "cpp", "markdown": "md", "md": "md", "toml": "toml", "yaml": "yaml", "yml": "yaml", "json": "json", "text": "txt", "txt": "txt", "shell": "sh", "bash": "sh", "sh": "sh", "pdf": "pdf",
}
CODE_LANGUAGES = ("rs", "ts", "js", "py", "go", "java", "c", "cpp")
# Paths ignored unless a configuration says otherwise; * first means suffix, anything else substring.
DEFAULT_IGNORES = (
    ".git", ".DS_Store", "node_modules", ".venv", "venv", "target", "dist", "build", "__pycache__", ".env", "*.lock", "package-lock.json", "yarn.lock", "gen", "docs", "design",
    "*.md", "benches", "*.py", "*.min.js", "*.min.css", "*.bundle.js", "*.map",
)


def extension(path: Column) -> Column:
    """The lower-cased extension of a path; a bare file name is its own (``Dockerfile``)."""
    return F.lower(F.substring_index(F.substring_index(path, "/", -1), ".", -1))


def language_of(path: Column) -> Column:
    """The short language name of a path, null if its extension has none. A constant map lookup, no join."""
    pairs = [F.lit(x) for lang, exts in EXTENSIONS.items() for e in exts for x in (e, lang)]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def clean_language(language: Column, path: Column) -> Column:
    """A language column in any spelling as short name; where it says nothing, the path's."""
    pairs = [F.lit(x) for a, lang in ALIASES.items() for x in (a, lang)]
    name = F.lower(F.trim(language))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.when(name.isin(*EXTENSIONS), name), language_of(path))


def language_filter(name: str | None) -> str | None:
    """The short name for a filter argument; an unknown name filters nothing."""
    return ALIASES.get((name or "").lower())


def ignored(path: Column, patterns=DEFAULT_IGNORES) -> Column:
    """Does any pattern fit the path?"""
    hits = [path.endswith(p[1:]) if p.startswith("*") else F.contains(path, F.lit(p)) for p in patterns]
    return reduce(lambda a, b: a | b, hits, F.lit(False))
