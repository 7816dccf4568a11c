"""Scans over chunks: annotations, security patterns, file lists, statistics, sample terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.languages import clean_language
from ..functions.text import lines

# Annotation tags in the order in which they count.
TODO_TAGS = ("TODO", "FIXME", "HACK", "XXX", "NOCOMMIT", "DEPRECATED")
# Security patterns (severity, kind, pattern, is the line lower-cased first?).
SECURITY_PATTERNS = (
    ("high", "hardcoded_secret", 'password = "', True),
    ("high", "hardcoded_secret", "password = '", True),
    ("high", "hardcoded_secret", 'secret_key = "', True),
    ("high", "hardcoded_secret", 'secret = "', True),
    ("high", "hardcoded_secret", 'api_key = "', True),
    ("high", "hardcoded_secret", "api_key = '", True),
    ("high", "hardcoded_secret", "aws_secret", True),
    ("high", "exposed_private_key", "BEGIN RSA PRIVATE KEY", True),
    ("high", "exposed_private_key", "BEGIN PRIVATE KEY", True),
    ("medium", "unsafe_eval", "eval(", False),
    ("medium", "xss_risk", ".innerHTML =", False),
    ("medium", "xss_risk", "innerHTML+=", False),
    ("medium", "xss_risk", "dangerouslySetInnerHTML", False),
    ("medium", "xss_risk", "document.write(", False),
    ("medium", "shell_injection", "os.system(", False),
    ("medium", "shell_injection", "subprocess.call(", False),
    ("medium", "shell_injection", "subprocess.Popen(", False),
    ("medium", "shell_injection", "shell=True", False),
    ("medium", "sql_injection", 'cursor.execute(f"', False),
    ("medium", "sql_injection", "cursor.execute(f'", False),
    ("medium", "sql_injection", 'execute("SELECT', False),
    ("low", "todo_security", "TODO: security", False),
    ("low", "todo_security", "FIXME: security", False),
    ("low", "security_suppression", "nosec", False),
    ("low", "security_suppression", "#nosec", False),
    ("low", "lint_suppression", "// eslint-disable", False),
)
SECURITY_LIMIT, SNIPPET = 300, 150


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """(id, file_path, line, raw, language): each line of each row; overlapping chunks and repeated rows give a line more
    than once. Repeats are dropped from what a scan finds: no text is shuffled to drop them before."""
    lang = clean_language(F.col("language"), F.col("file_path")).alias("language")
    return chunks.select("id", "file_path", "line_start", lang, F.posexplode(lines(F.col("content"))).alias("pos", "raw")).select("id", "file_path", (F.col("line_start") + F.col("pos")).alias("line"), F.col("raw"), "language")


def todo_kind(text: Column) -> Column:
    """The first tag, in their order, that the upper-cased text contains."""
    up = F.upper(text)
    return F.coalesce(*(F.when(F.contains(up, F.lit(t)), t) for t in TODO_TAGS))


def scan_todos(chunks: DataFrame) -> DataFrame:
    """(file_path, line, kind, text, language), a row for each line with a tag."""
    d = chunk_lines(chunks).withColumn("kind", todo_kind(F.col("raw"))).where("kind is not null").dropDuplicates(["id", "line"])
    return d.select("file_path", "line", "kind", F.trim("raw").alias("text"), "language")


def security_hits(chunks: DataFrame, patterns=SECURITY_PATTERNS, fix_private_keys: bool = False) -> DataFrame:
    """(severity, kind, file_path, line, snippet): lines that contain a pattern, each kind once a line.

    Patterns are constants of the plan: every line is tested in one pass, without a join. ``fix_private_keys`` compares
    the private key patterns with the line as it is; otherwise, compared with a lower-cased line, they never match.
    """
    d = chunk_lines(chunks)
    low = F.lower("raw")
    tests = []
    for severity, kind, pattern, lowered in patterns:
        text = F.col("raw") if not lowered or (fix_private_keys and kind == "exposed_private_key") else low
        tests.append(F.when(F.contains(text, F.lit(pattern)), F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"))))
    hits = F.array_distinct(F.filter(F.array(*tests), lambda x: x.isNotNull()))
    d = d.select("file_path", "line", "raw", F.explode(hits).alias("h"))
    s = d.select("h.severity", "h.kind", "file_path", "line", F.substring(F.trim("raw"), 1, SNIPPET).alias("snippet"))
    return s.groupBy("severity", "kind", "file_path", "line").agg(F.min("snippet").alias("snippet"))


def severity_order(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).otherwise(2)


def scan_security(chunks: DataFrame, limit: int = SECURITY_LIMIT, **how) -> DataFrame:
    """The gravest ``limit`` findings, by severity, file and line."""
    return security_hits(chunks, **how).orderBy(severity_order(F.col("severity")), "file_path", "line", "kind").limit(limit)


def security_summary(chunks: DataFrame) -> DataFrame:
    """Findings by severity and kind, over all lines."""
    return security_hits(chunks).groupBy("severity", "kind").agg(F.count("*").alias("n_issues"))


def file_list(chunks: DataFrame) -> DataFrame:
    """(file_path, chunks, language of the first chunk)."""
    c = chunks.select("id", "file_path", "language").dropDuplicates(["id"]).select("id", "file_path", clean_language(F.col("language"), F.col("file_path")).alias("language"))
    return c.groupBy("file_path").agg(F.count("*").alias("chunks"), F.min_by("language", "id").alias("language"))


def language_counts(chunks: DataFrame) -> DataFrame:
    """Files and chunks by language."""
    return file_list(chunks).groupBy("language").agg(F.count("*").alias("n_files"), F.sum("chunks").alias("n_chunks"))


def index_stats(chunks: DataFrame) -> DataFrame:
    """One row: files, chunks, languages."""
    f = file_list(chunks)
    return f.agg(F.count("*").alias("n_files"), F.sum("chunks").alias("n_chunks"), F.count_distinct("language").alias("n_languages"))


def sample_queries(chunks: DataFrame, n: int = 100, n_words: int = 8) -> DataFrame:
    """About ``n`` chunks drawn evenly by a scrambled id, their first words as benchmark queries: (query_id, query)."""
    words = F.filter(F.split("content", r"\s+"), lambda w: w != "")
    c = chunks.where("id is not null").select("id", F.array_join(F.slice(words, 1, n_words), " ").alias("query")).dropDuplicates(["id"])
    return c.orderBy(F.pmod(F.col("id") * 40_503, F.lit(1_000_003)), "id").limit(n).select(F.col("id").alias("query_id"), "query")
