"""The keyword index and BM25 ranking.

Two ways to score: over a stored index (postings joined on the query's terms, for many queries) and by one scan of the
texts (term frequencies counted inside each text, nothing shuffled but the statistics, for a single query).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_terms, tokens
from ..session import cut

K1, B = 1.2, 0.75


def tokenized(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """(record_id, tokens); a null text has none."""
    return df.select(F.col(record_id), F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("tokens"))


def postings(tok: DataFrame, record_id: str) -> DataFrame:
    """(term, record_id, tf)."""
    return tok.select(F.explode("tokens").alias("term"), record_id).groupBy("term", record_id).agg(F.count("*").cast("int").alias("tf"))


def term_df(post: DataFrame) -> DataFrame:
    """(term, df): documents a term."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


def doc_lengths(tok: DataFrame, record_id: str) -> DataFrame:
    """(record_id, dl): tokens a document."""
    return tok.select(record_id, F.size("tokens").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: documents and their mean length."""
    return lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def vocabulary_size(post: DataFrame) -> DataFrame:
    return post.agg(F.count_distinct("term").alias("vocabulary"))


def without(df: DataFrame, deleted: DataFrame, record_id: str) -> DataFrame:
    """Soft delete: the rows that are not deleted. Statistics taken afterwards are those of the live rows."""
    return df.join(deleted.select(record_id).distinct(), record_id, "left_anti")


def idf(n: Column, df: Column) -> Column:
    """Never below zero, so stale statistics cannot turn a term against a document."""
    return F.greatest(F.lit(0.0), F.ln((n - df + 0.5) / (df + 0.5) + 1))


def tf_norm(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def score_index(post: DataFrame, dfs: DataFrame, lengths: DataFrame, stats: DataFrame, queries: DataFrame, record_id: str, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, record_id, score) for queries (query_id, term): the batch form over a stored index.

    Terms prune the postings first; the queries are joined without a hint, so their size decides the join.
    """
    q = queries.distinct()
    p = post.join(q.select("term").distinct(), "term", "left_semi").join(dfs, "term").join(lengths, record_id).join(F.broadcast(stats))
    one = idf(F.col("n"), F.col("df")) * tf_norm(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    return p.select("term", record_id, one.alias("part")).join(q, "term").groupBy("query_id", record_id).agg(F.sum("part").alias("score"))


def score_scan(df: DataFrame, record_id: str, text: str, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """(record_id, score) of one query in one scan: each text counts the query's terms itself. Repeated ids count once."""
    terms = query_terms(query)
    t = tokenized(df, record_id, text)
    if not terms:
        return t.select(record_id, F.lit(0.0).alias("score")).where(F.lit(False))
    t = t.select(record_id, F.size("tokens").alias("dl"), F.filter("tokens", lambda w: w.isin(*terms)).alias("hits"))

    def times(term: str) -> Column:
        return F.size(F.filter("hits", lambda w: w == F.lit(term)))

    # repeated rows count once, dropped when only numbers are left; written once, read for the statistics and the scores
    t = cut(t.select(record_id, "dl", *(times(x).alias(f"tf{i}") for i, x in enumerate(terms))).dropDuplicates([record_id]))
    stats = t.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))))
    parts = [F.when(F.col(f"tf{i}") > 0, idf(F.col("n"), F.col(f"df{i}")) * tf_norm(F.col(f"tf{i}"), F.col("dl"), F.col("avgdl"), k1, b)).otherwise(0.0) for i in range(len(terms))]
    s = t.join(F.broadcast(stats)).where("n > 0 and avgdl > 0").select(record_id, sum(parts, F.lit(0.0)).alias("score"))
    return s.where("score > 0")


def index_tables(chunks: DataFrame, record_id: str, text: str) -> dict[str, DataFrame]:
    """The tables a stored keyword index consists of: postings (term, record_id, tf, dl), term_df, corpus_stats.

    ``chunks`` has each id once. Texts are tokenized once; a posting holds its text's length, so a search joins no lengths.
    """
    t = cut(tokenized(chunks, record_id, text))
    p = t.select(record_id, F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("term", record_id).agg(F.count("*").cast("int").alias("tf"), F.first("dl").alias("dl"))
    p = cut(p)
    return {"postings": p.select("term", record_id, "tf", "dl"), "term_df": term_df(p), "corpus_stats": corpus_stats(doc_lengths(t, record_id))}


def search_index(index: dict[str, DataFrame], query: str, record_id: str, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """(record_id, score): the ``k`` best of one query over a stored index.

    Only the row groups of the query's terms are read: postings and frequencies are sorted by term. The frequencies
    joined are a row a query term, the statistics one row.
    """
    terms = query_terms(query)
    here = F.col("term").isin(*terms) if terms else F.lit(False)
    d = F.broadcast(index["term_df"].where(here).join(F.broadcast(index["corpus_stats"])).where("avgdl > 0"))
    one = idf(F.col("n"), F.col("df")) * tf_norm(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    s = index["postings"].where(here).join(d, "term").groupBy(record_id).agg(F.sum(one).alias("score")).where("score > 0")
    return top(s, record_id, k)


def top(scored: DataFrame, record_id: str, k: int) -> DataFrame:
    """The ``k`` best; equal scores (to 6 decimals) go by id."""
    r = scored.withColumn("score", F.round("score", 6))
    return r.orderBy(F.desc("score"), record_id).limit(k)
