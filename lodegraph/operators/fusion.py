"""Hybrid retrieval: reciprocal rank fusion, signals, overlap suppression, similar chunks, several indexes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import DIM, embed_text
from ..functions.languages import clean_language, language_filter
from ..session import cut
from . import bm25, vector

RRF_K, CANDIDATES, CANDIDATES_FILTERED, LIMIT = 60, 50, 200, 10


def ranked(df: DataFrame, record_id: str) -> DataFrame:
    """Positions from 0 in a short list (a top-k result)."""
    return df.withColumn("rank0", F.row_number().over(Window.orderBy(F.desc("score"), record_id)) - 1)


def reciprocal_rank_fusion(keyword: DataFrame, semantic: DataFrame, record_id: str, k: int = RRF_K) -> DataFrame:
    """(record_id, score, signal) from two lists (record_id, score): the sum of 1 / (k + position + 1), and who found it."""
    a = ranked(keyword, record_id).select(record_id, "rank0", F.lit(1).alias("kw"), F.lit(0).alias("sem"))
    b = ranked(semantic, record_id).select(record_id, "rank0", F.lit(0).alias("kw"), F.lit(1).alias("sem"))
    s = a.unionByName(b).groupBy(record_id).agg(F.sum(1.0 / (k + F.col("rank0") + 1)).alias("score"), F.max("kw").alias("kw"), F.max("sem").alias("sem"))
    signal = F.when((F.col("kw") == 1) & (F.col("sem") == 1), "HYBRID").when(F.col("kw") == 1, "KW").otherwise("SEM")
    return s.select(record_id, F.round("score", 9).alias("score"), signal.alias("signal"))


def overlap_share(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The overlap of two line spans as a share of the shorter; ends are exclusive, an empty span overlaps nothing."""
    shorter = F.least(e1 - s1, e2 - s2)
    return F.when(shorter > 0, F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0)) / shorter).otherwise(0.0)


def suppress_overlaps(hits: DataFrame, record_id: str, most: float = 0.5) -> DataFrame:
    """Greedy, best first: a hit is dropped if it overlaps a kept one of its file by more than ``most``.

    Files are independent, so each folds its own few hits; no global order is needed.
    """
    one = F.struct((-F.col("score")).alias("o"), F.col(record_id).alias("id"), F.col("line_start").alias("s"), F.col("line_end").alias("e"))
    f = hits.groupBy("file_path").agg(F.array_sort(F.collect_list(one)).alias("h"))
    kept = F.aggregate("h", F.slice("h", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: overlap_share(y["s"], y["e"], x["s"], x["e"]) > most), acc).otherwise(F.concat(acc, F.array(x))))
    ids = f.select(F.explode(kept).alias("x")).select(F.col("x.id").alias(record_id))
    return hits.join(ids, record_id, "left_semi")


def enrich(scored: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunk; ids that no chunk has are left out. The hits are few (top-k lists), so they go to the chunks;
    repeated chunks are dropped among what they meet."""
    c = chunks.select(F.col("id").alias("chunk_id"), "file_path", "line_start", "line_end", clean_language(F.col("language"), F.col("file_path")).alias("language"), "chunk_type", "content")
    return c.join(F.broadcast(scored), "chunk_id").dropDuplicates(["chunk_id"])


def finish(keyword: DataFrame, semantic: DataFrame, chunks: DataFrame, limit: int, lang: str | None, rrf_k: int) -> DataFrame:
    """Two candidate lists fused, with their chunks, filtered by language, without overlaps, the best ``limit``."""
    hits = enrich(reciprocal_rank_fusion(keyword, semantic, "chunk_id", rrf_k), chunks)
    if lang:
        hits = hits.where(F.col("language") == lang)
    return suppress_overlaps(cut(hits), "chunk_id").orderBy(F.desc("score"), "chunk_id").limit(limit)


def search(chunks: DataFrame, vectors: DataFrame, query: str, limit: int = LIMIT, language: str | None = None, rrf_k: int = RRF_K) -> DataFrame:
    """Hybrid search by a scan of the texts: keyword and vector candidates, fused and finished."""
    lang = language_filter(language)
    depth = CANDIDATES_FILTERED if lang else CANDIDATES
    kw = bm25.top(bm25.score_scan(chunks.withColumnRenamed("id", "chunk_id"), "chunk_id", "content", query), "chunk_id", depth)
    sem = vector.nearest(vectors, "chunk_id", "vec", [(0, embed_text(query, DIM))], depth).select("chunk_id", "score")
    return finish(kw, sem, chunks, limit, lang, rrf_k)


def search_index(index: dict[str, DataFrame], query: str, limit: int = LIMIT, language: str | None = None, rrf_k: int = RRF_K, probes: int | None = None) -> DataFrame:
    """Hybrid search over a stored index (``stored.build_index``): no text is read but that of the candidates.

    ``probes``: cells of the vector index that are searched; all vectors where it is None.
    """
    lang = language_filter(language)
    depth = CANDIDATES_FILTERED if lang else CANDIDATES
    kw = bm25.search_index(index, query, "chunk_id", depth)
    q = [(0, embed_text(query, DIM))]
    sem = vector.nearest(index["vectors"], "chunk_id", "vec", q, depth) if probes is None else vector.search_cells(index["vectors"], index["cells"], "chunk_id", q, depth, probes)
    return finish(kw, sem.select("chunk_id", "score"), index["chunks"], limit, lang, rrf_k)


def search_similar(chunks: DataFrame, vectors: DataFrame, text: str, limit: int = LIMIT, exclude: int | None = None) -> DataFrame:
    """Chunks whose vectors are nearest to a text's embedding; score 1 / (1 + distance)."""
    got = vector.nearest(vectors, "chunk_id", "vec", [(0, embed_text(text, DIM))], max(4 * limit, 40))
    s = got.select("chunk_id", F.round(1.0 / (1.0 + F.greatest(F.lit(0.0), 1.0 - F.col("score"))), 6).alias("score"), F.lit("SEM").alias("signal"))
    if exclude is not None:
        s = s.where(F.col("chunk_id") != exclude)
    return suppress_overlaps(cut(enrich(s, chunks)), "chunk_id").orderBy(F.desc("score"), "chunk_id").limit(limit)


def merge_indexes(results: list[DataFrame], limit: int) -> DataFrame:
    """Results of several indexes in one ranking."""
    return reduce(lambda a, b: a.unionByName(b), results).orderBy(F.desc("score"), "chunk_id").limit(limit)


def first_with_rows(*results: DataFrame) -> DataFrame:
    """The first result that has rows, in order of precedence."""
    for r in results[:-1]:
        if not r.isEmpty():
            return r
    return results[-1]
