"""Sources and sinks: directories of files, git logs, a stored index, reports and graph exports."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import DEFAULT_IGNORES, ignored, language_of

MOST_BYTES, MOST_PDF_BYTES = 1_000_000, 20_000_000


def scan_directory(spark: SparkSession, folder: str, ignores=DEFAULT_IGNORES, pdf_text: Callable[[bytes], str] | None = None) -> DataFrame:
    """(path, language, content) of every readable file under ``folder``: no dot names, no ignored paths, known extensions,
    not too large. Files that are no valid UTF-8 are left out; PDF files need ``pdf_text``, a function bytes -> text.

    Names, sizes and extensions are tested on the listing, before any content is read.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace("path", r"^file:/+", "/")
    f = f.withColumn("path", path).withColumn("language", language_of(F.col("path")))
    inside = F.substr("path", F.lit(len(folder.rstrip("/")) + 1))
    f = f.where(~inside.rlike(r"/\.") & ~ignored(F.col("path"), ignores) & F.col("language").isNotNull())
    f = f.where(F.when(F.col("language") == "pdf", F.col("length") <= MOST_PDF_BYTES).otherwise(F.col("length") <= MOST_BYTES))
    text = f.where("language <> 'pdf'").where(F.is_valid_utf8(F.col("content").cast("string"))).select("path", "language", F.col("content").cast("string").alias("content"))
    if pdf_text is None:
        return text

    @F.pandas_udf("string")
    def read(s):
        def one(b):
            try:
                return pdf_text(b)
            except Exception:  # noqa: BLE001  an unreadable file is left out
                return None

        return s.map(one)

    return text.unionByName(f.where("language = 'pdf'").select("path", "language", read("content").alias("content")).where("content is not null"))


def git_log(spark: SparkSession, folder: str, most: int = 1000) -> DataFrame:
    """(pos, line): authors and changed files of the last commits, as ``git log`` prints them."""
    got = subprocess.run(["git", "-C", folder, "log", "--format=%ae", "--name-only", "--diff-filter=MA", "-n", str(most)], capture_output=True, text=True, check=False)
    return spark.createDataFrame([(i, x) for i, x in enumerate(got.stdout.splitlines())], "pos long, line string")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of a stored log, numbered by its order in the file."""
    return spark.read.text(path, wholetext=False).select(F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


INDEX_TABLES = ("chunks", "postings", "term_df", "doc_len", "corpus_stats", "cells", "vectors", "nodes", "edges", "index_meta")


def save_index(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes an index's tables. Postings and frequencies are sorted by term, vectors by cell, so a query reads only the
    row groups that hold its own. Ranges run over the id too: a term or cell with a third of all rows is many files."""
    for name, df in tables.items():
        if name not in INDEX_TABLES:
            raise ValueError(f"no table of an index: {name}")
        keys = {"postings": ("term",), "term_df": ("term",), "vectors": ("cell",), "chunks": ("id",)}.get(name, ())
        keys = [k for k in keys if k in df.columns]
        if keys:
            rest = [c for c in ("chunk_id", "record_id", "doc_id") if c in df.columns]
            df = df.repartitionByRange(*keys, *rest).sortWithinPartitions(*keys, *rest)
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a stored index that are there."""
    out = {}
    for name in INDEX_TABLES:
        try:
            out[name] = spark.read.parquet(f"{folder}/{name}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return out


def disk_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """(table, n_files, bytes, size) of a stored index, and a row for all of it, from the listing alone."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    inside = F.substr("path", F.lit(0) + F.instr("path", folder.rstrip("/").split("/")[-1] + "/") + len(folder.rstrip("/").split("/")[-1]) + 1)
    t = f.select(F.substring_index(inside, "/", 1).alias("table"), "length")
    g = t.rollup("table").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    b = F.col("bytes")
    size = F.coalesce(*(F.when(b >= n, F.concat(F.format_number(b / n, 1), F.lit(f" {u}"))) for u, n in (("GB", 1e9), ("MB", 1e6), ("KB", 1e3))), F.concat(b.cast("string"), F.lit(" B")))
    return g.select(F.coalesce("table", F.lit("total")).alias("table"), "n_files", "bytes", size.alias("size"))


def graph_rows(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph as JSON lines for a viewer: one row a node, one a link."""
    n = nodes.select(F.to_json(F.struct("id", "name", "kind", "file_path", "line_start", "line_end")).alias("node"))
    e = edges.select(F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "kind")).alias("link"))
    return n, e


def graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes nodes and links as JSON files, in parallel."""
    nodes.select("id", "name", "kind", "file_path", "line_start", "line_end").write.mode("overwrite").json(f"{path}/nodes")
    edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "kind").write.mode("overwrite").json(f"{path}/links")


PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title><body><h1>{title}</h1><pre id="stats"></pre><ul id="nodes"></ul>
<script>const graph = {graph};
document.getElementById("stats").textContent = graph.nodes.length + " nodes, " + graph.links.length + " links";
for (const n of graph.nodes) {{ const li = document.createElement("li"); li.textContent = n.kind + " " + n.name + " " + n.file_path; document.getElementById("nodes").append(li); }}
</script></body>"""


def graph_page(nodes: DataFrame, edges: DataFrame, title: str = "Code graph", most: int = 5000) -> str:
    """A stand-alone page of the ``most`` best linked nodes and the links between them (a view, bounded by what a page can show)."""
    deg = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").count()
    top = nodes.join(deg, "id").orderBy(F.desc("count"), "id").limit(most).select("id", "name", "kind", "file_path")
    keep = top.select("id")
    links = edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")
    data = {"nodes": [r.asDict() for r in top.collect()], "links": [r.asDict() for r in links.select("src", "dst", "kind").limit(10 * most).collect()]}
    return PAGE.format(title=title, graph=json.dumps(data).replace("</", "<\\/"))


def report(gods: DataFrame, listing: DataFrame, surprises: DataFrame) -> str:
    """A Markdown report of three short rankings."""
    out = ["# Code graph report", "", "## Most connected", ""]
    out += [f"{i}. `{r['name']}` ({r['kind']}) — {r['degree']} calls — {r['file_path']}" for i, r in enumerate(gods.collect(), 1)]
    out += ["", "## Communities", ""]
    out += [f"- {r['community']}: {r['size']} nodes, mostly {r['file_path'] or 'modules'}" + (f": {r['members']}" if r["members"] else "") for r in listing.collect()]
    out += ["", "## Links between communities", ""]
    out += [f"- {r['src']} → {r['dst']} ({r['bridges']} between {r['lo']} and {r['hi']})" for r in surprises.collect()]
    return "\n".join(out) + "\n"
