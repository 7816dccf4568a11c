"""One object over an index's tables, with a method for each question, and a dispatcher by tool name for thin servers.

Every method returns a DataFrame; nothing is collected but for ``handle``, which answers one JSON-RPC line.
"""

from __future__ import annotations

import json
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, IndexNotFound, QueryError
from .functions.text import query_terms, snippet
from .operators import fusion, graph_analytics, scans
from .session import cut
from .sources.files import load_index


# Usual and greatest number of rows by surface and question.
LIMITS = {
    "library": {"search": (10, 1_000_000), "similar": (10, 1_000_000), "explain": (6, 12)},
    "cli": {"search": (10, 1_000_000), "similar": (10, 1_000_000), "explain": (6, 12)},
    "http": {"search": (12, 50), "similar": (10, 30), "explain": (8, 8)},
    "tools": {"search": (5, 20), "similar": (5, 20), "explain": (6, 12)},
}


class CodeIndex:
    """chunks, vectors, nodes and edges of one index."""

    def __init__(self, chunks: DataFrame, vectors: DataFrame, nodes: DataFrame, edges: DataFrame, config: Config | None = None, words: dict[str, DataFrame] | None = None) -> None:
        """``words``: the stored keyword index (postings, term_df, corpus_stats, cells), if there is one; searches then read it."""
        self.chunks, self.vectors, self.nodes, self.edges = chunks, vectors, nodes, edges
        self.config = config or Config()
        self.words = words

    @classmethod
    def load(cls, spark: SparkSession, folder: str, config: Config | None = None) -> CodeIndex:
        t = load_index(spark, folder)
        missing = [x for x in ("chunks", "vectors", "nodes", "edges") if x not in t]
        if missing:
            raise IndexNotFound(f"{folder} has no {', '.join(missing)}")
        stored = all(x in t for x in ("postings", "term_df", "corpus_stats"))
        return cls(t["chunks"], t["vectors"], t["nodes"], t["edges"], config, t if stored else None)

    def _limit(self, what: str, asked: int | None) -> int:
        """The rows asked for, else the surface's usual number, and at most its greatest."""
        usual, most = LIMITS[self.config.surface][what]
        return max(1, min(asked or (self.config.limit if self.config.surface == "library" else usual), most))

    @cached_property
    def _communities(self) -> DataFrame:
        return graph_analytics.communities(self.nodes, self.edges)

    def search_code(self, query: str, limit: int | None = None, language: str | None = None) -> DataFrame:
        n = self._limit("search", limit)
        if self.words:
            hits = fusion.search_index(self.words, query, n, language, self.config.rrf_k)
        else:
            hits = fusion.search(self.chunks, self.vectors, query, n, language, self.config.rrf_k)
        return hits.withColumn("snippet", snippet(F.col("content"), query_terms(query), self.config.snippet_lines))

    def find_similar(self, text: str, limit: int | None = None, exclude: int | None = None) -> DataFrame:
        return fusion.search_similar(self.chunks, self.vectors, text, self._limit("similar", limit), exclude)

    def find_callers(self, name: str) -> DataFrame:
        return graph_analytics.callers(self.nodes, self.edges, name)

    def find_callees(self, name: str) -> DataFrame:
        return graph_analytics.callees(self.nodes, self.edges, name)

    def get_endpoints(self) -> DataFrame:
        return graph_analytics.endpoints(self.nodes)

    def get_file_structure(self, path: str) -> DataFrame:
        return graph_analytics.file_structure(self.nodes, self.edges, path)

    def get_stats(self) -> DataFrame:
        return scans.index_stats(self.chunks).join(F.broadcast(graph_analytics.graph_stats(self.nodes, self.edges)))

    def get_languages(self) -> DataFrame:
        return scans.language_counts(self.chunks).orderBy(F.desc("n_files"), "language")

    def get_god_nodes(self, limit: int = 10) -> DataFrame:
        return graph_analytics.god_nodes(self.nodes, self.edges, limit)

    def get_communities(self, limit: int = 8) -> DataFrame:
        return graph_analytics.community_listing(self.nodes, self._communities, limit)

    def get_surprises(self, limit: int = 15) -> DataFrame:
        return graph_analytics.surprise_edges(self.nodes, self.edges, self._communities, limit)

    def get_health_score(self) -> DataFrame:
        return graph_analytics.health_report(self.nodes, self.edges)

    def get_security_scan(self) -> DataFrame:
        return scans.scan_security(self.chunks)

    def get_patterns(self) -> dict[str, DataFrame]:
        n, e = self.nodes, self.edges
        return {
            "god_objects": graph_analytics.call_hubs(n, e), "long_files": graph_analytics.long_files(n), "high_coupling": graph_analytics.high_coupling(n, e),
            "layer_violations": graph_analytics.layer_violations(n, e).orderBy("src", "dst").limit(20), "singleton_suspects": graph_analytics.singleton_suspects(n),
        }

    def get_todos(self) -> DataFrame:
        return scans.scan_todos(self.chunks).orderBy("file_path", "line", "kind")

    def get_files(self) -> DataFrame:
        return scans.file_list(self.chunks).orderBy("file_path")

    def blast_radius(self, file_path: str) -> DataFrame:
        return graph_analytics.blast_radius(self.nodes, self.edges, file_path).orderBy("depth", "path")

    def explain(self, query: str, limit: int | None = None) -> DataFrame:
        """The context of a question, for a model to answer from: (part, rank, text). Hits; callers and callees of the
        definition around the best hit; members of its community (12 at most); the most connected nodes."""
        ga = graph_analytics
        hits = cut(self.search_code(query, self._limit("explain", limit)).select("chunk_id", "file_path", "line_start", "score", "content"))
        top = hits.orderBy(F.desc("score"), "chunk_id").limit(1).select(F.lit(1).alias("point_id"), "file_path", F.col("line_start").alias("line"))
        around = cut(ga.enclosing_definition(top, self.nodes).select(F.col("id").alias("at")))
        calls = ga.clean_edges(self.edges).where("kind = 'calls'")
        near = calls.join(F.broadcast(around), (F.col("src") == F.col("at")) | (F.col("dst") == F.col("at"))).select(F.when(F.col("src") == F.col("at"), "callee").otherwise("caller").alias("part"), F.when(F.col("src") == F.col("at"), F.col("dst")).otherwise(F.col("src")).alias("id"))
        names = near.join(ga.clean_nodes(self.nodes).select("id", "name", "file_path"), "id").select("part", F.lit(0).alias("rank"), F.concat_ws(" ", "name", "file_path").alias("text"))
        its = self._communities.join(F.broadcast(around), F.col("id") == F.col("at"), "left_semi").select("community")
        members = ga.community_members(self.nodes, self._communities, its, 12).select(F.lit("community").alias("part"), "rank", F.concat_ws(" ", "name", "file_path").alias("text"))
        gods = self.get_god_nodes(5).select(F.lit("hub").alias("part"), F.col("degree").cast("int").alias("rank"), F.concat_ws(" ", "name", "file_path").alias("text"))
        found = hits.select(F.lit("hit").alias("part"), F.col("line_start").alias("rank"), F.concat_ws("\n", "file_path", "content").alias("text"))
        return found.unionByName(names).unionByName(members).unionByName(gods)


TOOLS = (
    "search_code", "find_callers", "find_callees", "get_endpoints", "get_file_structure", "find_similar", "get_stats", "get_god_nodes", "get_communities", "get_surprises", "explain", "get_health_score", "get_security_scan", "blast_radius",
    "get_languages", "get_todos", "get_files",
)


def call(index: CodeIndex, tool: str, arguments: dict | None = None) -> DataFrame:
    """A tool by its name."""
    if tool not in TOOLS:
        raise QueryError(f"no such tool: {tool}")
    try:
        return getattr(index, tool)(**(arguments or {}))
    except TypeError as e:
        raise QueryError(str(e)) from e


def handle(index: CodeIndex, line: str, most: int = 200) -> str:
    """One line of JSON-RPC 2.0 in, one out; at most ``most`` rows of an answer."""
    number = None
    try:
        req = json.loads(line)
        number, method, params = req.get("id"), req.get("method"), req.get("params") or {}
        if method == "tools/list":
            result: object = {"tools": [{"name": t} for t in TOOLS]}
        elif method == "tools/call":
            rows = call(index, params.get("name", ""), params.get("arguments")).limit(most).toJSON().collect()
            result = {"rows": [json.loads(r) for r in rows]}
        else:
            return json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": -32601, "message": f"no such method: {method}"}})
        return json.dumps({"jsonrpc": "2.0", "id": number, "result": result})
    except (ValueError, QueryError) as e:
        return json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": -32602, "message": str(e)}})
