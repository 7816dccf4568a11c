"""Every query of the library by name, with the SQL that checks it.

Queries run over whole tables. ``chunks`` has repeated rows, so each query counts an id once; nodes and edges likewise.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, languages, text
from ..functions.hashing import embed_text
from ..operators import bm25, chunking, fusion, graph_analytics, graph_build, scans, stored, vector
from ..session import cut, shared_folder
from ..streaming import upsert

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, Callable[[], str]] = {}

PROBES = 12
SEARCH_TEXT = "decode ledger checksum retry"
SEARCH_TEXTS = {1: SEARCH_TEXT, 2: "blocks until the lease is handed over", 3: "snapshot position compact format", 4: "Index des token bereits geschlossen"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: Callable[[], str] | str | None = None, name: str | None = None):
    """Registers a query by its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        n = name or f.__name__
        _QUERIES[n] = f
        if sql is not None:
            _SQL[n] = sql if callable(sql) else (lambda: sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {n: f() for n, f in _SQL.items()}


def files_of(spark: SparkSession, sf: str) -> DataFrame:
    """Files as (path, language, content): what the change feed has left of them, and their chunks' language."""
    f = upsert.live_content(table(spark, sf, "change_feed")).where("content is not null")
    return f.select("path", languages.language_of(F.col("path")).alias("language"), "content").where("language is not null")


def index_of(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return stored.ensure_index(spark, table(spark, sf, "chunks"), table(spark, sf, "vectors"))


# --- SQL fragments -----------------------------------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return ", ".join(_q(x) for x in xs)


ONE = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY id) = 1)"
NODES = "(SELECT * FROM nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY id) = 1)"
EDGES = "(SELECT DISTINCT src, dst, kind FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL)"
CALLS = f"(SELECT src, dst FROM {EDGES} WHERE kind = 'calls')"
IMPORTS = f"(SELECT src, dst FROM {EDGES} WHERE kind = 'imports')"


def sql_tokens(col: str, stop: bool = True, decompose: bool = True) -> str:
    """The tokenizer in SQL: a list of tokens."""
    a, b = text.decomposed()
    t = f"lower(translate(regexp_replace({col}, '([{a}])', '\\1 ', 'g'), '{a}', '{b}'))" if decompose else f"lower({col})"
    words = f"list_filter(regexp_split_to_array({t}, '{text.SPLIT_SQL}'), lambda w: strlen(w) >= 2)"
    keep = f"x NOT IN ({_list(text.STOPWORDS)})" if stop else "true"
    parts = "CASE WHEN contains(w, '_') THEN list_concat([w], list_filter(string_split(w, '_'), lambda p: strlen(p) >= 2)) ELSE [w] END"
    return f"list_filter(flatten(list_transform({words}, lambda w: {parts})), lambda x: {keep})"


def sql_language(language: str = "language", path: str = "file_path") -> str:
    al = " ".join(f"WHEN {_q(a)} THEN {_q(v)}" for a, v in languages.ALIASES.items() if a not in languages.EXTENSIONS)
    ex = " ".join(f"WHEN {_q(e)} THEN {_q(v)}" for v, es in languages.EXTENSIONS.items() for e in es)
    low = f"lower(trim({language}))"
    ext = f"lower(list_last(string_split(list_last(string_split({path}, '/')), '.')))"
    return f"coalesce(CASE {low} {al} END, CASE WHEN {low} IN ({_list(languages.EXTENSIONS)}) THEN {low} END, CASE {ext} {ex} END)"


def sql_lines(col: str) -> str:
    return f"(CASE WHEN {col} = '' THEN [] ELSE string_split(regexp_replace(regexp_replace({col}, '\\r?\\n$', ''), '\\r\\n', '\n', 'g'), chr(10)) END)".replace("'\n'", "chr(10)")


def _bm25_sql(terms: list[str], k: int | None, ids: str = "chunk_id", src: str = "", where: str = "") -> str:
    src = src or f"(SELECT id AS chunk_id, {sql_tokens('content')} AS t FROM {ONE})"
    return f"""
      d AS (SELECT {ids}, t, len(t) AS dl FROM {src}),
      s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
      p AS (SELECT {ids}, dl, q.term, len(list_filter(t, lambda x: x = q.term)) AS tf FROM d, (SELECT unnest([{_list(terms)}]) AS term) q),
      f AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM p GROUP BY term),
      kw AS (SELECT {ids}, round(sum(greatest(0.0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
             FROM p JOIN f USING (term), s WHERE tf > 0 {where} GROUP BY {ids} {f'ORDER BY score DESC, {ids} LIMIT {k}' if k else ''})"""


def _vector_sql(q: list[float], k: int) -> str:
    lit = "[" + ", ".join(repr(float(x)) for x in q) + "]::DOUBLE[]"
    return f"""
      v AS (SELECT chunk_id, vec::DOUBLE[] AS x FROM (SELECT DISTINCT embedding_id, chunk_id, vec FROM vectors) WHERE vec IS NOT NULL AND len(vec) = {len(q)} AND list_inner_product(vec::DOUBLE[], vec::DOUBLE[]) > 1e-16),
      sem AS (SELECT DISTINCT chunk_id, round(list_inner_product(x, {lit}) / sqrt(list_inner_product(x, x)), 6) AS score FROM v ORDER BY score DESC, chunk_id LIMIT {k})"""


# --- retrieval ---------------------------------------------------------------------------------------------------


@query(lambda: f"WITH {_bm25_sql(text.query_terms(SEARCH_TEXT), 50)} SELECT chunk_id, score FROM kw")
def keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    """One query over the stored index."""
    return bm25.search_index(index_of(spark, sf), SEARCH_TEXT, "chunk_id", 50)


@query(lambda: f"WITH {_bm25_sql(text.query_terms(SEARCH_TEXT), 50)} SELECT chunk_id, score FROM kw")
def keyword_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The same query without an index, in one scan."""
    c = table(spark, sf, "chunks").select(F.col("id").alias("chunk_id"), "content")
    return bm25.top(bm25.score_scan(c, "chunk_id", "content", SEARCH_TEXT), "chunk_id", 50)


@query(f"""WITH t AS (SELECT id, {sql_tokens('content')} AS t FROM {ONE}), p AS (SELECT id, unnest(t) AS term FROM t)
  SELECT (SELECT count(*) FROM t) AS n_chunks, (SELECT count(*) FROM (SELECT DISTINCT id, term FROM p)) AS n_postings, (SELECT count(DISTINCT term) FROM p) AS n_terms, (SELECT round(avg(len(t)), 6) FROM t) AS avgdl""")
def index_build(spark: SparkSession, sf: str) -> DataFrame:
    """Builds the stored index (once a session), and counts what is in it."""
    x = index_of(spark, sf)
    counts = x["chunks"].agg(F.count("*").alias("n_chunks"))
    for d in (x["postings"].agg(F.count("*").alias("n_postings")), x["term_df"].agg(F.count("*").alias("n_terms")), x["corpus_stats"].select(F.round("avgdl", 6).alias("avgdl"))):
        counts = counts.join(F.broadcast(d))  # one row each
    return counts


@query(lambda: f"WITH {_vector_sql(embed_text(SEARCH_TEXT), 50)} SELECT chunk_id, score FROM sem")
def vector_search(spark: SparkSession, sf: str) -> DataFrame:
    return vector.nearest(table(spark, sf, "vectors"), "chunk_id", "vec", [(0, embed_text(SEARCH_TEXT))], 50).select("chunk_id", "score")


def _hybrid_sql(depth: int, limit: int, language: str | None) -> str:
    return f"""
    WITH RECURSIVE {_bm25_sql(text.query_terms(SEARCH_TEXT), depth)}, {_vector_sql(embed_text(SEARCH_TEXT), depth)},
      lists AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS r, 1 AS kw, 0 AS sem FROM kw
               UNION ALL SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) - 1, 0, 1 FROM sem),
      fz AS MATERIALIZED (SELECT chunk_id, round(sum(1.0::DOUBLE / (60 + r + 1)), 9) AS score, CASE WHEN max(kw) + max(sem) = 2 THEN 'HYBRID' WHEN max(kw) = 1 THEN 'KW' ELSE 'SEM' END AS signal FROM lists GROUP BY chunk_id),
      {_finish_sql(limit, language)}"""


def _finish_sql(limit: int, language: str | None = None) -> str:
    """Fused hits ``fz`` with their chunks, without overlaps, the best ``limit``."""
    return f"""hz AS MATERIALIZED (SELECT fz.*, c.file_path, c.line_start, c.line_end, {sql_language('c.language', 'c.file_path')} AS language, c.chunk_type FROM fz JOIN {ONE} c ON c.id = fz.chunk_id),
      g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, chunk_id) AS n FROM hz {f"WHERE language = {_q(language)}" if language else ''}),
      walk AS (
        SELECT file_path, n, [chunk_id] AS ids, [{{'s': line_start, 'e': line_end}}] AS kept FROM g WHERE n = 1
        UNION ALL
        SELECT w.file_path, g.n,
          CASE WHEN drop_it THEN ids ELSE list_append(ids, g.chunk_id) END, CASE WHEN drop_it THEN kept ELSE list_append(kept, {{'s': line_start, 'e': line_end}}) END
        FROM walk w JOIN g ON g.file_path = w.file_path AND g.n = w.n + 1,
          LATERAL (SELECT len(list_filter(w.kept, lambda k: least(k.e - k.s, g.line_end - g.line_start) > 0 AND greatest(0, least(k.e, g.line_end) - greatest(k.s, g.line_start)) / greatest(1, least(k.e - k.s, g.line_end - g.line_start)) > 0.5)) > 0 AS drop_it)),
      keep AS (SELECT unnest(ids) AS chunk_id FROM (SELECT file_path, arg_max(ids, n) AS ids FROM walk GROUP BY file_path))
    SELECT g.chunk_id, g.file_path, g.line_start, g.line_end, g.language, g.chunk_type, g.score, g.signal FROM g JOIN keep USING (chunk_id) ORDER BY g.score DESC, g.chunk_id LIMIT {limit}"""


HIT = ["chunk_id", "file_path", "line_start", "line_end", "language", "chunk_type", "score", "signal"]


@query(lambda: _hybrid_sql(50, 10, None))
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.search_index(index_of(spark, sf), SEARCH_TEXT).select(*HIT)


@query(lambda: _hybrid_sql(50, 10, None))
def hybrid_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The same search without a stored index."""
    return fusion.search(table(spark, sf, "chunks"), table(spark, sf, "vectors"), SEARCH_TEXT).select(*HIT)


@query(lambda: _hybrid_sql(200, 12, "rs"))
def hybrid_search_language(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.search_index(index_of(spark, sf), SEARCH_TEXT, 12, "rust").select(*HIT)


SIMILAR_TEXT = "fn refresh_cache(ledger: u64) -> usize { ledger.push(digest); }"


def _similar_sql() -> str:
    return f"""WITH RECURSIVE {_vector_sql(embed_text(SIMILAR_TEXT), 40)},
      fz AS MATERIALIZED (SELECT chunk_id, round(1.0::DOUBLE / (1 + greatest(0, 1 - score)), 6) AS score, 'SEM' AS signal FROM sem), {_finish_sql(10)}"""


@query(_similar_sql)
def search_similar(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.search_similar(table(spark, sf, "chunks"), table(spark, sf, "vectors"), SIMILAR_TEXT).select(*HIT)


@query(r"""WITH c AS (SELECT id, list_filter(regexp_split_to_array(any_value(content), '\s+'), lambda w: w <> '')[1:8] AS w FROM chunks WHERE id IS NOT NULL GROUP BY id)
  SELECT id AS query_id, coalesce(array_to_string(w, ' '), '') AS query FROM c ORDER BY ((id * 40503) % 1000003 + 1000003) % 1000003, id LIMIT 100""")
def sample_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Queries for a benchmark, from the chunks themselves."""
    return scans.sample_queries(table(spark, sf, "chunks"))


LIVE = "(SELECT * FROM chunks WHERE id NOT IN (SELECT id FROM chunks WHERE status = 'Tombstoned') QUALIFY row_number() OVER (PARTITION BY id ORDER BY id) = 1)"


_LIVE_TOKENS = f"(SELECT id AS chunk_id, {sql_tokens('content')} AS t FROM {LIVE})"


@query(lambda: f"WITH {_bm25_sql(text.query_terms(SEARCH_TEXT), 20, src=_LIVE_TOKENS)} SELECT chunk_id, score FROM kw")
def live_keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword search after a soft delete: tombstoned chunks are gone, from the statistics too."""
    c = table(spark, sf, "chunks").withColumnRenamed("id", "chunk_id")
    c = bm25.without(c, c.where("status = 'Tombstoned'"), "chunk_id").select("chunk_id", "content")
    return bm25.top(bm25.score_scan(c, "chunk_id", "content", SEARCH_TEXT), "chunk_id", 20)


def _merged_sql() -> str:
    t = text.query_terms(SEARCH_TEXT)
    docs = f"(SELECT doc_id AS chunk_id, {sql_tokens('text')} AS t FROM documents WHERE text IS NOT NULL)"
    return f"""SELECT * FROM (SELECT 'chunks' AS source, chunk_id, score FROM (WITH {_bm25_sql(t, 12)} SELECT chunk_id, score FROM kw)
      UNION ALL SELECT 'documents', chunk_id, score FROM (WITH {_bm25_sql(t, 12, src=docs)} SELECT chunk_id, score FROM kw)) ORDER BY score DESC, chunk_id LIMIT 12"""


@query(_merged_sql)
def merged_indexes(spark: SparkSession, sf: str) -> DataFrame:
    """One ranking over two indexes, the chunks' and the documents'."""
    c = table(spark, sf, "chunks").select(F.col("id").alias("chunk_id"), F.col("content").alias("text"))
    d = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("chunk_id"), "text")
    parts = [bm25.top(bm25.score_scan(x, "chunk_id", "text", SEARCH_TEXT), "chunk_id", 12).select(F.lit(n).alias("source"), "chunk_id", "score") for n, x in (("chunks", c), ("documents", d))]
    return fusion.merge_indexes(parts, 12)


@query(f"""WITH t AS (SELECT id, unnest({sql_tokens('content')}) AS term FROM {ONE}) SELECT term, id AS chunk_id, CAST(count(*) AS INTEGER) AS tf FROM t GROUP BY ALL""")
def postings(spark: SparkSession, sf: str) -> DataFrame:
    return index_of(spark, sf)["postings"].select("term", "chunk_id", "tf")


@query(f"""WITH t AS (SELECT DISTINCT id, unnest({sql_tokens('content')}) AS term FROM {ONE}) SELECT term, count(*) AS df FROM t GROUP BY ALL""")
def term_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return index_of(spark, sf)["term_df"]


@query(f"""WITH t AS (SELECT len({sql_tokens('content')}) AS dl FROM {ONE}) SELECT count(*) AS n, round(avg(dl), 6) AS avgdl, max(dl) AS longest FROM t""")
def corpus_statistics(spark: SparkSession, sf: str) -> DataFrame:
    t = bm25.tokenized(table(spark, sf, "chunks"), "id", "content")
    return bm25.doc_lengths(t, "id").dropDuplicates(["id"]).agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"), F.max("dl").alias("longest"))


@query(f"""SELECT count(DISTINCT term) AS vocabulary FROM (SELECT unnest({sql_tokens('content')}) AS term FROM {ONE})""")
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.vocabulary_size(postings(spark, sf))


def _batch_sql() -> str:
    rows = ", ".join(f"({i}, {_q(t)})" for i, s in SEARCH_TEXTS.items() for t in text.query_terms(s))
    return f"""
    WITH q(query_id, term) AS (VALUES {rows}), d AS (SELECT doc_id, {sql_tokens('text')} AS t FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, len(t) AS dl FROM d),
      s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
      r AS (SELECT query_id, doc_id, round(sum(greatest(0.0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term) JOIN l USING (doc_id), s GROUP BY ALL)
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r QUALIFY rank <= 10"""


@query(_batch_sql)
def batch_keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    """Several queries over the documents in one job."""
    from pyspark.sql import Window

    d = table(spark, sf, "documents").where("text is not null")
    t = cut(bm25.tokenized(d, "doc_id", "text"))  # postings, frequencies and lengths all read it
    post = bm25.postings(t, "doc_id")
    lengths = bm25.doc_lengths(t, "doc_id")
    q = spark.createDataFrame([(i, x) for i, s in SEARCH_TEXTS.items() for x in text.query_terms(s)], "query_id int, term string")
    r = bm25.score_index(post, bm25.term_df(post), lengths, bm25.corpus_stats(lengths), q, "doc_id").withColumn("score", F.round("score", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return r.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


@query(f"""WITH t AS (SELECT doc_id, {sql_tokens('text')} AS t FROM documents) SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms FROM t WHERE t IS NOT NULL""")
def document_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("t")).where("t is not null")
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"))


# --- vectors -----------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 50 = 0)
  SELECT q.vec_id AS query_id, e.vec_id, round(list_inner_product(q.v, e.v) / sqrt(list_inner_product(q.v, q.v)) / sqrt(list_inner_product(e.v, e.v)), 6) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, e.vec_id) AS rank FROM q, e QUALIFY rank <= 10""")
def exact_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of every fiftieth embedding among all."""
    e = table(spark, sf, "embeddings")
    return vector.nearest_in_blocks(e, "vec_id", "embedding", e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE vec IS NULL OR len(vec) <> 384) AS n_bad_length, count(*) FILTER (WHERE len(vec) = 384 AND list_inner_product(vec::DOUBLE[], vec::DOUBLE[]) = 0) AS n_zero,
  round(avg(sqrt(list_inner_product(vec::DOUBLE[], vec::DOUBLE[]))) FILTER (WHERE len(vec) = 384), 6) AS mean_norm FROM (SELECT DISTINCT * FROM vectors)""")
def vector_health(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "vectors").dropDuplicates()
    n = F.when(F.size("vec") == 384, vector.norm(F.col("vec")))
    v = v.select("vec", n.alias("n"))
    return v.agg(F.count("*").alias("n"), F.count_if(F.col("vec").isNull() | (F.size("vec") != 384)).alias("n_bad_length"), F.count_if(F.col("n") == 0).alias("n_zero"), F.round(F.avg("n"), 6).alias("mean_norm"))


@query()
def text_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Hash embeddings of all documents, in sparse form."""
    d = table(spark, sf, "documents").where("text is not null")
    return hashing.sparse_embedding(d, "doc_id", "text").select("doc_id", "pos", F.round("value", 6).alias("value"))


@query()
def approximate_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall at 10 of the stored vector index against exact search, for every fiftieth vector among all.

    The queries come in blocks; each block reads the cells its queries probe.
    """
    x = index_of(spark, sf)
    v = table(spark, sf, "vectors").where("chunk_id is not null").groupBy("chunk_id").agg(F.first("vec").alias("vec"))
    q = cut(v.where("chunk_id % 50 = 0 and size(vec) = 384"))
    exact = vector.nearest_in_blocks(table(spark, sf, "vectors"), "chunk_id", "vec", q, "chunk_id", "vec", 10)
    got = vector.probe_in_cells(x["vectors"], x["cells"], "chunk_id", q, "chunk_id", "vec", 10, probes=PROBES)
    return vector.recall(got, exact, "chunk_id")


# --- chunking ----------------------------------------------------------------------------------------------------


def _paragraph_sql() -> str:
    return f"""
    WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
      n AS (SELECT *, len({sql_lines('p')}) AS n FROM p),
      s AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS line_start FROM n)
    SELECT CAST(doc_id AS VARCHAR) AS path, CAST(line_start AS INTEGER) AS line_start, CAST(line_start + n - 1 AS INTEGER) AS line_end, md5(trim(p, ' ')) AS digest FROM s WHERE len(list_filter(regexp_split_to_array(p, '\\s+'), lambda w: w <> '')) >= 3"""


@query(_paragraph_sql)
def paragraph_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.lit("txt").alias("language"), F.col("text").alias("content"))
    return chunking.paragraphs(d).select("path", "line_start", "line_end", F.md5("content").alias("digest"))


def _window_sql() -> str:
    return f"""
    WITH f AS (SELECT id, {sql_lines('content')} AS ls FROM {ONE} WHERE content IS NOT NULL), s AS (SELECT id, ls, unnest(range(0, len(ls), 30)) AS s FROM f WHERE len(ls) > 0),
      w AS (SELECT CAST(id AS VARCHAR) AS path, CAST(s + 1 AS INTEGER) AS line_start, CAST(least(s + 40, len(ls)) AS INTEGER) AS line_end, array_to_string(ls[s + 1 : s + 40], chr(10)) AS t FROM s WHERE s = 0 OR s + 10 < len(ls))
    SELECT path, line_start, line_end, md5(t) AS digest FROM w WHERE len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) >= 3"""


@query(_window_sql)
def line_window_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").where("content is not null").select(F.col("id").cast("string").alias("path"), "language", "content")
    return chunking.line_windows(c).select("path", "line_start", "line_end", F.md5("content").alias("digest")).distinct()


def _markdown_sql() -> str:
    return f"""
    WITH f AS (SELECT doc_id, {sql_lines('text')} AS ls FROM documents WHERE text IS NOT NULL),
      l AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM f WHERE len(ls) > 0),
      g AS (SELECT *, sum(CASE WHEN starts_with(x, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM l)
    SELECT CAST(doc_id AS VARCHAR) AS path, CAST(min(i) AS INTEGER) AS line_start, CAST(max(i) AS INTEGER) AS line_end, md5(string_agg(x, chr(10) ORDER BY i)) AS digest FROM g GROUP BY doc_id, g HAVING trim(string_agg(x, chr(10) ORDER BY i), ' ') <> ''"""


@query(_markdown_sql)
def markdown_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.lit("md").alias("language"), F.col("text").alias("content"))
    return chunking.markdown_sections(d).select("path", "line_start", "line_end", F.md5("content").alias("digest"))


@query()
def chunked_files(spark: SparkSession, sf: str) -> DataFrame:
    """All chunking rules over the files the change feed has left."""
    return chunking.with_ids(chunking.chunk_files(files_of(spark, sf)))


# --- scans -------------------------------------------------------------------------------------------------------

_LINES = f"SELECT file_path, line_start + i - 1 AS line, x, lang FROM (SELECT file_path, line_start, {sql_language()} AS lang, unnest({sql_lines('content')}) AS x, generate_subscripts({sql_lines('content')}, 1) AS i FROM {ONE} WHERE content IS NOT NULL)"


@query(lambda: f"""WITH l AS ({_LINES}), k AS (SELECT *, CASE {' '.join(f"WHEN contains(upper(x), '{t}') THEN '{t}'" for t in scans.TODO_TAGS)} END AS kind FROM l)
  SELECT file_path, CAST(line AS INTEGER) AS line, kind, trim(x, ' ') AS text, lang AS language FROM k WHERE kind IS NOT NULL""")
def todos(spark: SparkSession, sf: str) -> DataFrame:
    return scans.scan_todos(table(spark, sf, "chunks"))


def _security_sql() -> str:
    pats = " UNION ALL ".join(f"SELECT {_q(s)} AS severity, {_q(k)} AS kind, {_q(p)} AS pattern, {str(low).lower()} AS low" for s, k, p, low in scans.SECURITY_PATTERNS)
    return f"""WITH l AS ({_LINES}), p AS ({pats}), h AS (SELECT severity, kind, file_path, CAST(line AS INTEGER) AS line, min(substr(trim(x, ' '), 1, 150)) AS snippet FROM l, p WHERE contains(CASE WHEN low THEN lower(x) ELSE x END, pattern) GROUP BY ALL)"""


@query(lambda: _security_sql() + " SELECT * FROM h")
def security_issues_all(spark: SparkSession, sf: str) -> DataFrame:
    return scans.security_hits(table(spark, sf, "chunks"))


@query(lambda: _security_sql() + " SELECT * FROM h ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, file_path, line, kind LIMIT 300")
def security_report(spark: SparkSession, sf: str) -> DataFrame:
    return scans.scan_security(table(spark, sf, "chunks"))


@query(lambda: _security_sql() + " SELECT severity, kind, count(*) AS n_issues FROM h GROUP BY ALL")
def security_counts(spark: SparkSession, sf: str) -> DataFrame:
    return scans.security_summary(table(spark, sf, "chunks"))


@query(f"SELECT file_path, count(*) AS chunks, arg_min({sql_language()}, id) AS language FROM {ONE} GROUP BY file_path")
def file_list(spark: SparkSession, sf: str) -> DataFrame:
    return scans.file_list(table(spark, sf, "chunks"))


@query(f"SELECT language, count(*) AS n_files, CAST(sum(chunks) AS BIGINT) AS n_chunks FROM (SELECT file_path, count(*) AS chunks, arg_min({sql_language()}, id) AS language FROM {ONE} GROUP BY file_path) GROUP BY language")
def language_counts(spark: SparkSession, sf: str) -> DataFrame:
    return scans.language_counts(table(spark, sf, "chunks"))


@query(f"SELECT count(*) AS n_files, CAST(sum(chunks) AS BIGINT) AS n_chunks, count(DISTINCT language) AS n_languages FROM (SELECT file_path, count(*) AS chunks, arg_min({sql_language()}, id) AS language FROM {ONE} GROUP BY file_path)")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return scans.index_stats(table(spark, sf, "chunks"))


@query(lambda: f"""SELECT file_path, {' OR '.join(f"ends_with(file_path, {_q(p[1:])})" if p.startswith('*') else f"contains(file_path, {_q(p)})" for p in languages.DEFAULT_IGNORES)} AS ignored FROM (SELECT DISTINCT file_path FROM chunks WHERE file_path IS NOT NULL)""")
def ignored_files(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "chunks").select("file_path").where("file_path is not null").distinct()
    return f.select("file_path", languages.ignored(F.col("file_path")).alias("ignored"))


def _snippet_sql() -> str:
    n = lambda x: " + ".join(f"CAST(contains(lower({x}), {_q(t)}) AS INTEGER)" for t in text.query_terms(SEARCH_TEXT))
    return f"""WITH c AS (SELECT id, file_path, {sql_lines('content')} AS ls FROM {ONE} WHERE {n('content')} > 0),
      s AS (SELECT *, list_transform(ls, lambda x: {n('x')}) AS ns FROM c), b AS (SELECT *, len(ls) AS n, list_max(list_filter(range(len(ls)), lambda i: ns[i + 1] = list_max(ns))) AS best FROM s),
      w AS (SELECT *, least(greatest(best - 3, 0) + 6, n) AS stop FROM b)
    SELECT id AS chunk_id, CASE WHEN n <= 6 THEN array_to_string(ls, chr(10)) ELSE array_to_string(ls[greatest(stop - 6, 0) + 1 : stop], chr(10)) || CASE WHEN stop < n THEN chr(10) || '  ...' ELSE '' END END AS snippet,
      array_to_string(string_split(file_path, '/')[-2:], '/') AS place FROM w"""


@query(_snippet_sql)
def snippets(spark: SparkSession, sf: str) -> DataFrame:
    """What a result card shows of every chunk that has a term of the query."""
    terms = text.query_terms(SEARCH_TEXT)
    c = table(spark, sf, "chunks").where(F.size(text.matching_terms(F.col("content"), terms)) > 0)
    return c.select(F.col("id").alias("chunk_id"), text.snippet(F.col("content"), terms).alias("snippet"), text.last_two(F.col("file_path")).alias("place")).dropDuplicates(["chunk_id"])


# --- graph -------------------------------------------------------------------------------------------------------


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf, "nodes"), table(spark, sf, "edges")


@query(f"""SELECT (SELECT count(*) FROM {NODES}) AS total_nodes, (SELECT count(*) FROM {EDGES}) AS total_edges, count(*) FILTER (WHERE kind = 'function') AS functions, count(*) FILTER (WHERE kind = 'method') AS methods,
  count(*) FILTER (WHERE kind IN ('class', 'struct', 'trait')) AS classes, count(*) FILTER (WHERE kind = 'endpoint') AS endpoints, count(*) FILTER (WHERE kind = 'module') AS modules FROM {NODES}""")
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return graph_analytics.graph_stats(*_graph(spark, sf))


_DEGREE = f"(SELECT id, count(*) AS degree FROM (SELECT src AS id FROM {CALLS} UNION ALL SELECT dst FROM {CALLS}) GROUP BY id)"


@query(f"SELECT n.id, name, kind, file_path, degree FROM {NODES} n JOIN {_DEGREE} d USING (id) WHERE kind <> 'module' ORDER BY degree DESC, id LIMIT 20")
def god_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph_analytics.god_nodes(*_graph(spark, sf), 20)


_SIDES = f"(SELECT x.id, x.nbr FROM (SELECT DISTINCT src, dst FROM {EDGES} WHERE kind IN ('calls', 'imports')), LATERAL (SELECT src AS id, dst AS nbr UNION ALL SELECT dst, src) x)"
_TURN = "(pow(((a.id::BIGINT % 1000003 + 1000003) % 1000003 + 1) * (40503 + 7919 * (a.r // 2)) % 1000003, 2)::BIGINT >> 7) % 2 = a.r % 2"
_COMMUNITIES = f"""s AS MATERIALIZED {_SIDES},
  lab(id, label, r) AS (SELECT id, id::BIGINT, 0 FROM {NODES} UNION ALL
    SELECT a.id, CASE WHEN {_TURN} AND b.new IS NOT NULL THEN b.new ELSE a.label END, a.r + 1 FROM lab a LEFT JOIN (
      SELECT id, arg_max(label, (n, mine, -label)) AS new FROM (
        SELECT s.id, x.label, count(*) AS n, max(CASE WHEN x.label = o.label THEN 1 ELSE 0 END) AS mine FROM s JOIN lab x ON x.id = s.nbr JOIN lab o ON o.id = s.id GROUP BY s.id, x.label) GROUP BY id) b ON b.id = a.id
    WHERE a.r < 50),
  com AS MATERIALIZED (SELECT id, label AS community FROM lab WHERE r = 50)"""


@query(f"WITH RECURSIVE {_COMMUNITIES} SELECT id, community FROM com")
def communities(spark: SparkSession, sf: str) -> DataFrame:
    return graph_analytics.communities(*_graph(spark, sf))


@query(f"""WITH RECURSIVE {_COMMUNITIES}, p AS (SELECT src, dst, least(a.community, b.community) AS lo, greatest(a.community, b.community) AS hi FROM {CALLS} e JOIN com a ON a.id = src JOIN com b ON b.id = dst WHERE a.community <> b.community)
  SELECT src, dst, lo, hi, count(*) OVER (PARTITION BY lo, hi) AS bridges FROM p ORDER BY bridges, src, dst LIMIT 15""")
def surprise_edges(spark: SparkSession, sf: str) -> DataFrame:
    n, e = _graph(spark, sf)
    return graph_analytics.surprise_edges(n, e, graph_analytics.communities(n, e))


@query(f"""WITH RECURSIVE {_COMMUNITIES}, n AS (SELECT * FROM {NODES} JOIN com USING (id)), t AS (SELECT community, count(*) AS size, count(*) FILTER (WHERE kind <> 'module') AS n_members FROM n GROUP BY community ORDER BY size DESC, community LIMIT 8),
  f AS (SELECT community, file_path, count(*) AS c FROM n WHERE kind <> 'module' GROUP BY ALL), m AS (SELECT community, name, row_number() OVER (PARTITION BY community ORDER BY file_path, line_start, id) AS k FROM n WHERE kind <> 'module')
  SELECT t.*, (SELECT arg_min(file_path, (-c, file_path)) FROM f WHERE f.community = t.community) AS file_path, (SELECT string_agg(name, ', ' ORDER BY k) FROM m WHERE m.community = t.community AND k <= 10) AS members FROM t""")
def community_listing(spark: SparkSession, sf: str) -> DataFrame:
    n, e = _graph(spark, sf)
    return graph_analytics.community_listing(n, graph_analytics.communities(n, e))


HUB_FILE = "/repos/harbor-mono/core/src/ledger_ops.rs"
_BLAST = f"""WITH RECURSIVE b AS (SELECT dst AS id, src AS nxt FROM {EDGES} WHERE kind IN ('calls', 'imports')),
  r(id) AS (SELECT id FROM {NODES} WHERE file_path = '{HUB_FILE}' UNION SELECT nxt FROM r JOIN b USING (id))"""


@query(f"{_BLAST} SELECT DISTINCT file_path AS path FROM r JOIN {NODES} n USING (id) WHERE file_path <> '{HUB_FILE}'")
def blast_files(spark: SparkSession, sf: str) -> DataFrame:
    return graph_analytics.blast_radius(*_graph(spark, sf), HUB_FILE).select("path")


_DEPTHS = f"""WITH RECURSIVE b AS MATERIALIZED (SELECT DISTINCT dst AS id, src AS nxt FROM {EDGES} WHERE kind IN ('calls', 'imports')),
  r(id, depth) USING KEY (id) AS (SELECT id, 0 FROM {NODES} WHERE file_path = '{HUB_FILE}' UNION SELECT DISTINCT b.nxt, r.depth + 1 FROM r JOIN b USING (id) WHERE b.nxt NOT IN (SELECT id FROM recurring.r)),
  files AS (SELECT file_path AS path, CAST(min(depth) AS INTEGER) AS depth FROM r JOIN {NODES} n USING (id) WHERE file_path <> '{HUB_FILE}' GROUP BY file_path)"""


@query(f"{_DEPTHS} SELECT path, depth FROM files")
def blast_radius(spark: SparkSession, sf: str) -> DataFrame:
    return graph_analytics.blast_radius(*_graph(spark, sf), HUB_FILE)


@query(f"{_DEPTHS} SELECT count(*) AS total_files, CAST(least(100, least(70, 8 * count(*)) + least(30, coalesce(max(depth), 0))) AS INTEGER) AS risk_score FROM files")
def blast_risk(spark: SparkSession, sf: str) -> DataFrame:
    return graph_analytics.blast_risk(blast_radius(spark, sf))


_HUB = f"(SELECT name FROM {NODES} n JOIN {_DEGREE} d USING (id) WHERE kind <> 'module' ORDER BY degree DESC, id LIMIT 1)"


def _hub_name(spark: SparkSession, sf: str) -> str:
    r = graph_analytics.god_nodes(*_graph(spark, sf), 1).collect()
    return r[0]["name"] if r else ""


@query(f"SELECT id, name, kind, file_path, line_start FROM {NODES} WHERE id IN (SELECT src FROM {CALLS} WHERE dst IN (SELECT id FROM {NODES} n WHERE n.name = {_HUB} OR ends_with(n.name, '::' || {_HUB})))")
def callers(spark: SparkSession, sf: str) -> DataFrame:
    return graph_analytics.callers(*_graph(spark, sf), _hub_name(spark, sf))


_CALLER = f"(SELECT arg_min(name, id) FROM {NODES} WHERE id IN (SELECT src FROM {CALLS} WHERE dst IN (SELECT id FROM {NODES} n WHERE n.name = {_HUB})))"


@query(f"SELECT id, name, kind, file_path, line_start FROM {NODES} WHERE id IN (SELECT dst FROM {CALLS} WHERE src IN (SELECT id FROM {NODES} n WHERE n.name = {_CALLER} OR ends_with(n.name, '::' || {_CALLER})))")
def callees(spark: SparkSession, sf: str) -> DataFrame:
    """What the first caller of the most connected function calls."""
    n, e = _graph(spark, sf)
    first = graph_analytics.callers(n, e, _hub_name(spark, sf)).orderBy("id").limit(1).collect()
    return graph_analytics.callees(n, e, first[0]["name"] if first else "")


@query(lambda: f"SELECT id, name, file_path, line_start, detail FROM {NODES} WHERE kind IN ('function', 'method') AND contains(lower(file_path), '/handlers/')")
def endpoints(spark: SparkSession, sf: str) -> DataFrame:
    """The tables have no node of this kind; here the definitions in folders of handlers stand for the routes' handlers."""
    n = table(spark, sf, "nodes")
    routed = F.col("kind").isin("function", "method") & F.contains(F.lower("file_path"), F.lit("/handlers/"))
    return graph_analytics.endpoints(n.withColumn("kind", F.when(routed, "endpoint").otherwise(F.col("kind"))))


_RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(graph_analytics.KIND_ORDER)) + f" ELSE {len(graph_analytics.KIND_ORDER)} END"


@query(f"SELECT id, name, kind, line_start, line_end, {_RANK} AS rank FROM {NODES} WHERE id IN (SELECT dst FROM {EDGES} WHERE kind = 'contains' AND src = (SELECT min(id) FROM {NODES} WHERE kind = 'module' AND contains(lower(file_path), 'ledger_ops.rs')))")
def file_structure(spark: SparkSession, sf: str) -> DataFrame:
    return graph_analytics.file_structure(*_graph(spark, sf), "ledger_ops.rs")


@query(f"SELECT n.id, name, file_path, degree FROM {NODES} n JOIN {_DEGREE} d USING (id) WHERE kind IN ('function', 'method') AND degree >= 5")
def degree_gods(spark: SparkSession, sf: str) -> DataFrame:
    return graph_analytics.degree_gods(*_graph(spark, sf), 5)


@query(lambda: f"""SELECT id, name, file_path FROM {NODES} n WHERE kind = 'function' AND id NOT IN (SELECT dst FROM {CALLS}) AND NOT starts_with(list_last(string_split(name, '::')), '_')
  AND list_last(string_split(name, '::')) NOT IN ({_list(graph_analytics.ENTRY_NAMES)})""")
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    return graph_analytics.orphans(*_graph(spark, sf))


@query(f"SELECT id, file_path, line_end - line_start AS n_lines FROM {NODES} WHERE kind = 'module' AND line_end - line_start > 600")
def long_files(spark: SparkSession, sf: str) -> DataFrame:
    return graph_analytics.long_files(table(spark, sf, "nodes"))


@query(f"""SELECT m AS n_modules, i AS n_imports, CAST(CASE WHEN m > 0 THEN i // m ELSE 0 END AS BIGINT) AS avg_coupling FROM (SELECT count(*) AS m FROM {NODES} WHERE kind = 'module'), (SELECT count(*) AS i FROM {IMPORTS})""")
def coupling(spark: SparkSession, sf: str) -> DataFrame:
    return graph_analytics.coupling(*_graph(spark, sf))


def _cycles_sql(links: str) -> str:
    """Strongly connected components of more than one module, by their smallest id, as mutual reachability."""
    return f"""l AS MATERIALIZED ({links}), reach(a, b) AS (SELECT src, dst FROM l UNION SELECT reach.a, l.dst FROM reach JOIN l ON l.src = reach.b),
      cyc AS (SELECT x.a AS id, min(least(x.b, x.a)) AS cycle FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)"""


_MODULE_LINKS = f"SELECT DISTINCT src, dst FROM {IMPORTS} WHERE src <> dst AND src IN (SELECT id FROM {NODES} WHERE kind = 'module') AND dst IN (SELECT id FROM {NODES} WHERE kind = 'module')"
_LIFTED = f"""SELECT DISTINCT a.m AS src, b.m AS dst FROM {EDGES} e JOIN mods a ON a.id = e.src JOIN mods b ON b.id = e.dst WHERE e.kind IN ('calls', 'imports') AND a.m <> b.m"""
_AT = f"mods AS MATERIALIZED (SELECT n.id, m FROM {NODES} n JOIN (SELECT file_path, min(id) AS m FROM {NODES} WHERE kind = 'module' GROUP BY file_path) USING (file_path))"


@query(f"WITH RECURSIVE {_AT}, {_cycles_sql(_LIFTED)} SELECT id, cycle FROM cyc")
def cyclic_modules(spark: SparkSession, sf: str) -> DataFrame:
    """Cycles of files that use each other, by imports or through calls (by imports alone the tables have none)."""
    n, e = _graph(spark, sf)
    return graph_analytics.cyclic_modules(n, graph_analytics.lifted(n, e))


def _health_sql() -> str:
    return f"""WITH RECURSIVE {_cycles_sql(_MODULE_LINKS)}, c AS (SELECT least(count(DISTINCT cycle), 10) AS n_cycles FROM cyc),
      g AS (SELECT count(*) AS n_gods FROM {NODES} n JOIN {_DEGREE} d USING (id) WHERE kind IN ('function', 'method') AND degree >= {graph_analytics.GOD_DEGREE}),
      o AS (SELECT least(count(*), 20) AS n_orphans FROM {NODES} WHERE kind = 'function' AND id NOT IN (SELECT dst FROM {CALLS}) AND NOT starts_with(list_last(string_split(name, '::')), '_') AND list_last(string_split(name, '::')) NOT IN ({_list(graph_analytics.ENTRY_NAMES)})),
      f AS (SELECT count(*) AS n_long FROM {NODES} WHERE kind = 'module' AND line_end - line_start > 600),
      k AS (SELECT CAST(CASE WHEN m > 0 THEN i // m ELSE 0 END AS BIGINT) AS avg_coupling FROM (SELECT count(*) AS m FROM {NODES} WHERE kind = 'module'), (SELECT count(*) AS i FROM {IMPORTS})),
      p AS (SELECT *, CAST(greatest(100 - least(15 * n_cycles, 40) - least(5 * n_gods, 25) - least(n_orphans // 25, 10) - least(3 * n_long, 15) - CASE WHEN avg_coupling > 10 THEN 15 WHEN avg_coupling > 5 THEN 7 ELSE 0 END, 0) AS INTEGER) AS score FROM c, g, o, f, k)
    SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM p"""


@query(_health_sql)
def health_report(spark: SparkSession, sf: str) -> DataFrame:
    return graph_analytics.health_report(*_graph(spark, sf))


@query(f"SELECT n.id, name, file_path, calls FROM {NODES} n JOIN (SELECT src AS id, CAST(count(*) AS BIGINT) AS calls FROM {CALLS} GROUP BY src) USING (id) WHERE calls >= 1")
def call_hubs(spark: SparkSession, sf: str) -> DataFrame:
    return graph_analytics.call_hubs(*_graph(spark, sf), 1)


@query(f"SELECT file_path, count(*) AS imports FROM {IMPORTS} e JOIN {NODES} n ON n.id = e.src AND n.kind = 'module' GROUP BY file_path HAVING count(*) > 1")
def high_coupling(spark: SparkSession, sf: str) -> DataFrame:
    return graph_analytics.high_coupling(*_graph(spark, sf), 1)


def _layers_sql() -> str:
    case = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(file_path), {_q(m)})" for m in marks) + f" THEN {_q(n)}" for n, marks, _ in graph_analytics.LAYERS) + " END"
    rank = lambda c: f"CASE {c} " + " ".join(f"WHEN {_q(n)} THEN {r}" for n, _, r in graph_analytics.LAYERS) + " END"
    return f"""WITH l AS (SELECT id, file_path, {case} AS layer FROM {NODES} WHERE kind = 'module')
      SELECT e.src, e.dst, a.file_path AS from_path, b.file_path AS to_path, a.layer AS from_layer, b.layer AS to_layer FROM {IMPORTS} e JOIN l a ON a.id = e.src JOIN l b ON b.id = e.dst WHERE {rank('a.layer')} < {rank('b.layer')}"""


@query(_layers_sql)
def layer_violations(spark: SparkSession, sf: str) -> DataFrame:
    return graph_analytics.layer_violations(*_graph(spark, sf))


@query(f"SELECT id, name, file_path FROM {NODES} WHERE kind IN ('struct', 'class') AND (contains(lower(name), 'singleton') OR contains(lower(name), 'registry') OR lower(name) IN ('config', 'settings'))")
def singleton_suspects(spark: SparkSession, sf: str) -> DataFrame:
    return graph_analytics.singleton_suspects(table(spark, sf, "nodes"))


@query(f"""WITH p AS (SELECT DISTINCT issue_id AS point_id, file AS file_path, line FROM security_issues), d AS (SELECT * FROM {NODES} WHERE kind IN ('function', 'method')),
  j AS (SELECT point_id, d.id, d.name, row_number() OVER (PARTITION BY point_id ORDER BY p.line - line_start, d.id, d.name) AS n FROM p JOIN d USING (file_path) WHERE line BETWEEN line_start AND line_end)
  SELECT point_id, id, name FROM j WHERE n = 1""")
def enclosing_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """The function around every finding of the scanner."""
    p = table(spark, sf, "security_issues").select(F.col("issue_id").alias("point_id"), F.col("file").alias("file_path"), "line").distinct()
    return graph_analytics.enclosing_definition(p, table(spark, sf, "nodes"))


@query()
def explained(spark: SparkSession, sf: str) -> DataFrame:
    """The context of a question: hits, callers, callees, community, hubs."""
    from ..api import CodeIndex

    x = index_of(spark, sf)
    return CodeIndex(x["chunks"], x["vectors"], *_graph(spark, sf), words=x).explain(SEARCH_TEXT)


@query(f"SELECT DISTINCT id FROM (SELECT 1 AS id UNION ALL SELECT src FROM {EDGES} WHERE dst = 1 UNION ALL SELECT dst FROM {EDGES} WHERE src = 1)")
def neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    return graph_analytics.neighbourhood(table(spark, sf, "edges"), 1)


@query(f"SELECT id, name, kind, file_path FROM {NODES} WHERE contains(lower(name), 'ledger') OR contains(lower(file_path), 'ledger')")
def filtered_graph(spark: SparkSession, sf: str) -> DataFrame:
    return graph_analytics.filter_graph(table(spark, sf, "nodes"), "ledger").select("id", "name", "kind", "file_path")


@query()
def built_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph_build.build_graph(files_of(spark, sf))[0]


@query()
def built_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph_build.build_graph(files_of(spark, sf))[1]


def _churn_sql() -> str:
    return """WITH c AS (SELECT 'user' || c_custkey || '@example.test' AS author, 'part/' || l_partkey || '.rs' AS path FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey),
      b AS (SELECT path, author, count(*) AS n FROM c GROUP BY ALL)
    SELECT path, CAST(sum(n) AS BIGINT) AS commits, arg_min(author, {'n': -n, 'a': author}) AS owner FROM b GROUP BY path ORDER BY commits DESC, path LIMIT 200"""


@query(_churn_sql)
def churn(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as commits: the customer is the author, parts are the files."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    who = o.select((F.col("o_orderkey") * 100).alias("pos"), F.concat(F.lit("user"), F.col("c_custkey"), F.lit("@example.test")).alias("line"))
    li = table(spark, sf, "lineitem").join(o.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    what = li.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("part/"), F.col("l_partkey"), F.lit(".rs")).alias("line"))
    return graph_analytics.churn(who.unionByName(what))


# --- changes -----------------------------------------------------------------------------------------------------

_OP = "CASE WHEN regexp_matches(lower(trim(op)), '^(create|add)') THEN 'create' WHEN regexp_matches(lower(trim(op)), '^(modif|change|update|write)') THEN 'modify' WHEN regexp_matches(lower(trim(op)), '^(delet|remov|unlink)') THEN 'delete' END"
_PATH = r"regexp_replace(regexp_replace(replace(regexp_replace(trim(path), '^\\\\\?\\', ''), '\', '/'), '/\./', '/', 'g'), '/{2,}', '/', 'g')"
_FEED = f"(SELECT seq, {_PATH} AS path, {_OP} AS op, content, coalesce(ts, received_at) AS tm FROM change_feed WHERE path IS NOT NULL AND {_OP} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seq ORDER BY seq) = 1)"


@query(f"SELECT path, op, seq FROM {_FEED} QUALIFY row_number() OVER (PARTITION BY path ORDER BY tm DESC, seq DESC) = 1")
def latest_changes(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.latest(table(spark, sf, "change_feed")).select("path", "op", "seq")


@query(f"SELECT time_bucket(INTERVAL '1 hour', ts) AS start, {_OP} AS op, count(*) AS n FROM change_feed WHERE ts IS NOT NULL GROUP BY ALL")
def change_counts(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.change_counts(table(spark, sf, "change_feed"))


_LIVE_FILES = f"""WITH f AS {_FEED}, g AS (SELECT path, arg_max(op, (tm, seq)) AS op, max_by(tm, (tm, seq)) AS "at", max((tm, seq)) FILTER (WHERE op = 'delete') AS gone, max((tm, seq)) FILTER (WHERE content IS NOT NULL) AS fresh, arg_max(content, (tm, seq)) FILTER (WHERE content IS NOT NULL) AS content FROM f GROUP BY path)
  SELECT path, md5(CASE WHEN gone IS NULL OR fresh > gone THEN content END) AS digest, "at" FROM g WHERE op <> 'delete'"""


@query(_LIVE_FILES)
def live_files(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.live_content(table(spark, sf, "change_feed")).select("path", F.md5("content").alias("digest"), "at")


@query(f"SELECT path, op, seq, md5(content) AS digest FROM {_FEED} QUALIFY row_number() OVER (PARTITION BY path ORDER BY tm DESC, seq DESC) = 1")
def streamed_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The feed as a stream in micro-batches, its stored table read back: the same as the batch gives."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, sf, "change_feed").repartitionByRange(4, "seq").write.parquet(f"{folder}/in")
    upsert.upsert_stream(spark, f"{folder}/in", f"{folder}/t", f"{folder}/c", files=1).awaitTermination()
    return upsert.stored_changes(spark, f"{folder}/t").select("path", "op", "seq", F.md5("content").alias("digest"))


@query()
def streamed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The feed as a stream that re-chunks, re-embeds and re-links what changed; the chunks as they stand at the end."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, sf, "change_feed").repartitionByRange(2, "seq").write.parquet(f"{folder}/in")
    upsert.index_stream(spark, f"{folder}/in", folder, f"{folder}/c", files=1).awaitTermination()
    return upsert.current(spark, folder, "chunks")


@query(f"""WITH s AS (SELECT embedding_id, chunk_id, vec::DOUBLE[] AS v FROM (SELECT DISTINCT * FROM vectors WHERE len(vec) = 384)), u AS (SELECT embedding_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM s WHERE list_inner_product(v, v) > 1e-16)
  SELECT embedding_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS squared, round(list_max(v), 6) AS most FROM u""")
def normalized_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Unit vectors: their squared length, and their greatest entry."""
    v = vector.usable(table(spark, sf, "vectors"), "vec", 384).withColumn("v", vector.normalize(vector.require_dimension(F.col("vec"), 384)))
    return v.select("embedding_id", F.round(vector.dot(F.col("v"), F.col("v")), 6).alias("squared"), F.round(F.array_max("v"), 6).alias("most")).dropDuplicates(["embedding_id"])


@query("""WITH t AS (SELECT path, CASE WHEN length(path) > 40 THEN '…/' || right(path, 40) ELSE path END AS short, array_to_string(string_split(path, '/')[-2:], '/') AS place, date_diff('second', created, TIMESTAMP '2030-01-01') AS s FROM (SELECT DISTINCT file_path AS path, to_timestamp(min(created_at) OVER (PARTITION BY file_path)) AT TIME ZONE 'UTC' AS created FROM chunks WHERE created_at IS NOT NULL))
  SELECT path, short, place, CASE WHEN s < 60 THEN s || ' s ago' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || ' h ago' ELSE (s // 86400) || ' d ago' END AS age FROM t""")
def file_cards(spark: SparkSession, sf: str) -> DataFrame:
    """How a file list shows each path and its age (at a fixed day)."""
    f = table(spark, sf, "chunks").where("created_at is not null").groupBy(F.col("file_path").alias("path")).agg(F.min("created_at").alias("t"))
    p = F.col("path")
    return f.select("path", text.shorten_path(p, 40).alias("short"), text.last_two(p).alias("place"), text.ago(F.unix_timestamp(F.lit("2030-01-01 00:00:00")) - F.col("t")).alias("age"))
