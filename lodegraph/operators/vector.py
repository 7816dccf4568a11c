"""Vector operators: distances, exact and hashed nearest neighbours, diversity, soft delete, recall.

Vectors are array<float>; a usable one has the right length and is not zero. Bulk dot products run in Arrow batches with
numpy, and each batch keeps its best rows before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Unit length; a vector shorter than 1e-8 stays as it is."""
    # the norm is bound once, as the only entry of an array: within the inner function it would be taken for every entry
    by = lambda n: F.transform(v, lambda x: x.cast("double") / n)
    return F.transform(F.array(norm(v)), lambda n: by(F.when(n > 1e-8, n).otherwise(1.0)))[0]


def distance(a: Column, b: Column) -> Column:
    """Cosine distance of unit vectors, never below zero; 1 for a zero vector."""
    return F.greatest(F.lit(0.0), 1.0 - dot(a, b))


def require_dimension(v: Column, dim: int) -> Column:
    """The vector, or an error if its length is wrong."""
    return F.when(F.assert_true(F.size(v) == dim, F.lit(f"vector is not of dimension {dim}")).isNull(), v)


def usable(df: DataFrame, vec: str, dim: int) -> DataFrame:
    return df.where((F.size(vec) == dim) & F.exists(vec, lambda x: x != 0))


def nearest(df: DataFrame, record_id: str, vec: str, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """(query_id, record_id, score): exact k-NN by cosine of a few query vectors against all rows.

    Every task keeps its own best k a query; only those are ranked. Equal scores (6 decimals) go by id, repeats count once.
    """
    qid = np.array([q for q, _ in queries], np.int64)
    qv = np.array([v for _, v in queries], np.float64)
    qn = np.linalg.norm(qv, axis=1, keepdims=True)
    qv = np.divide(qv, qn, out=np.zeros_like(qv), where=qn > 1e-8)
    dim = qv.shape[1] if len(qv) else 0

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(qid)
        for b in batches:
            rows, m = matrix_of(b.column("vec"), dim)
            if not len(rows) or not len(qid):
                continue
            ids = b.column("id").to_numpy(zero_copy_only=False)[rows]
            s = np.round(m @ qv.T, 6)
            once = len(np.unique(ids)) == len(ids)
            for j in range(len(qid)):
                i, x = best_of(ids, s[:, j], k, once)
                best[j] = best_of(np.concatenate([best[j][0], i]), np.concatenate([best[j][1], x]), k, False)
        n = [len(i) for i, _ in best]
        if sum(n):
            yield pa.record_batch([pa.array(np.repeat(qid, n)), pa.array(np.concatenate([i for i, _ in best])), pa.array(np.concatenate([x for _, x in best]))], ["query_id", "id", "score"])

    d = df.where(F.col(record_id).isNotNull() & F.col(vec).isNotNull()).select(F.col(record_id).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("vec"))
    hits = d.mapInArrow(search, "query_id long, id long, score double").distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    r = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return r.select("query_id", F.col("id").alias(record_id), "score", "rank")


def best_of(ids: np.ndarray, scores: np.ndarray, k: int, once: bool) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best, equal scores by id, a repeated id and score once. ``once``: no id is repeated."""
    if once and len(scores) > k:
        ok = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[ok], scores[ok]
    o = np.lexsort((ids, -scores))
    ids, scores = ids[o], scores[o]
    new = np.r_[True, (np.diff(ids) != 0) | (np.diff(scores) != 0)] if len(ids) else np.empty(0, bool)
    return ids[new][:k], scores[new][:k]


def nearest_in_blocks(df: DataFrame, record_id: str, vec: str, queries: DataFrame, query_id: str, query_vec: str, k: int, block: int = 2048) -> DataFrame:
    """As ``nearest`` for a table of queries of any size: ``block`` of them at a time come to the driver, and each block
    is one pass over all rows, written to the shared folder before the next begins."""
    found: list[DataFrame] = []
    rows: list[tuple[int, list[float]]] = []

    def run() -> None:
        found.append(cut(nearest(df, record_id, vec, rows, k)))
        rows.clear()

    for r in queries.select(query_id, query_vec).toLocalIterator():
        rows.append((r[0], list(r[1])))
        if len(rows) >= block:
            run()
    if rows or not found:
        run()
    return reduce(lambda a, b: a.unionByName(b), found)


def matrix_of(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a column that are usable vectors, and their unit vectors."""
    if not len(col):
        return np.empty(0, int), np.empty((0, dim))
    off = col.offsets.to_numpy()
    rows = np.flatnonzero((np.diff(off) == dim) & ~np.asarray(col.is_null()))
    m = col.values.to_numpy(zero_copy_only=False)[off[rows][:, None] + np.arange(dim)].astype(np.float64)
    n = np.linalg.norm(m, axis=1)
    ok = np.isfinite(n) & (n > 1e-8)
    return rows[ok], m[ok] / n[ok, None]


# --- the stored vector index: cells around fitted centres --------------------------------------------------------

#: Rows the centres are fitted to at most; cells at most; a row stands in the cells of so many of its nearest centres.
CELL_SAMPLE, MOST_CELLS, SPREAD = 50_000, 1024, 2


def fit_cells(df: DataFrame, record_id: str, vec: str, dim: int, cells: int | None = None, rounds: int = 8) -> np.ndarray:
    """Centres by spherical k-means on a bounded sample drawn by a hash of the id: the square root of the rows, at most ``MOST_CELLS``."""
    d = usable(df, vec, dim)
    n = d.count()
    if n > CELL_SAMPLE:
        d = d.where(F.pmod(F.xxhash64(record_id), F.lit(1 << 30)) < int((1 << 30) * CELL_SAMPLE / n))
    t = d.select(F.col(vec).cast("array<float>").alias("vec")).toArrow().column("vec").combine_chunks()
    _, x = matrix_of(t.chunk(0) if isinstance(t, pa.ChunkedArray) else t, dim)
    if not len(x):
        return np.zeros((1, dim))
    rng = np.random.default_rng(3)
    c = x[rng.permutation(len(x))[: cells or int(np.clip(np.sqrt(n), 1, MOST_CELLS))]]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 8192] @ c.T).argmax(1) for i in range(0, len(x), 8192)])
        new = np.zeros_like(c)
        np.add.at(new, near, x)
        size = np.linalg.norm(new, axis=1, keepdims=True)
        c = np.where(size > 1e-8, new / np.maximum(size, 1e-8), c)
    return c


def in_cells(df: DataFrame, record_id: str, vec: str, centres: np.ndarray) -> DataFrame:
    """(cell, record_id, vec): every usable row in the cells of its ``SPREAD`` nearest centres."""
    dim, spread = centres.shape[1], min(SPREAD, len(centres))
    fitted = df.sparkSession.sparkContext.broadcast(centres)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, m = matrix_of(b.column("vec"), dim)
            if not len(rows):
                continue
            p = m @ fitted.value.T
            cell = np.argpartition(-p, spread - 1, axis=1)[:, :spread] if spread < p.shape[1] else np.tile(np.arange(spread), (len(p), 1))
            take = np.repeat(rows, spread)
            yield pa.record_batch([pa.array(cell.ravel().astype(np.int32)), b.column("id").take(pa.array(take)), b.column("vec").take(pa.array(take))], ["cell", record_id, "vec"])

    d = df.where(F.col(record_id).isNotNull() & F.col(vec).isNotNull()).select(F.col(record_id).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("vec"))
    return d.mapInArrow(read, f"cell int, {record_id} long, vec array<float>")


def search_cells(stored: DataFrame, centres: DataFrame, record_id: str, queries: list[tuple[int, list[float]]], k: int, probes: int) -> DataFrame:
    """Approximate k-NN over the stored cells: a few queries (as ``nearest`` takes) against the ``probes`` cells nearest to
    each. ``stored`` is sorted by cell, so the filter on it leaves row groups unread. ``centres``: (cell, centre), bounded.
    """
    c = centres.orderBy("cell").collect()
    cells = np.array([r["cell"] for r in c])
    p = np.array([q for _, q in queries]) @ np.array([r["centre"] for r in c]).T
    near = np.argsort(-p, axis=1, kind="stable")[:, :probes]
    read = sorted({int(x) for x in cells[near].ravel()})
    return nearest(stored.where(F.col("cell").isin(read)), record_id, "vec", queries, k)


def probe_in_cells(stored: DataFrame, centres: DataFrame, record_id: str, queries: DataFrame, query_id: str, query_vec: str, k: int, probes: int) -> DataFrame:
    """As ``search_cells`` for a table of queries: each is sent to its ``probes`` cells, and a cell compares its queries with
    its rows, batch by batch. Returns (query_id, record_id, score, rank)."""
    c = centres.orderBy("cell").collect()
    middle = np.array([r["centre"] for r in c])
    dim, probes = middle.shape[1], min(probes, len(middle))
    fitted = stored.sparkSession.sparkContext.broadcast(middle)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, m = matrix_of(b.column("vec"), dim)
            if not len(rows):
                continue
            cell = np.argsort(-(m @ fitted.value.T), axis=1, kind="stable")[:, :probes]
            take = pa.array(np.repeat(rows, probes))
            yield pa.record_batch([pa.array(cell.ravel().astype(np.int32)), b.column("id").take(take), b.column("vec").take(take)], ["cell", "query_id", "q"])

    sent = queries.select(F.col(query_id).cast("long").alias("id"), F.col(query_vec).cast("array<float>").alias("vec")).mapInArrow(send, "cell int, query_id long, q array<float>")

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        qr, q = matrix_of(left.column("q").combine_chunks(), dim)
        vr, v = matrix_of(right.column("vec").combine_chunks(), dim)
        qid, vid = left.column("query_id").to_numpy()[qr], right.column(record_id).to_numpy()[vr]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        once = len(np.unique(vid)) == len(vid)
        for i in range(0, len(q), 256):
            s = np.round(q[i : i + 256] @ v.T, 6)
            for j in range(len(s)):
                ids, x = best_of(vid, s[j], k, once)
                out.append((np.full(len(ids), qid[i + j]), ids, x))
        a, b, x = (np.concatenate(z) for z in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"query_id": a, "id": b, "score": x})

    hits = sent.groupBy("cell").cogroup(stored.groupBy("cell")).applyInArrow(compare, "query_id long, id long, score double").distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("id").alias(record_id), "score", "rank")


def diverse(candidates: Column, m: int) -> Column:
    """Diversity selection over an array of (score, id, vec), best first: one is kept unless a kept one is nearer to it than the query is."""
    return F.slice(
        F.aggregate(candidates, F.slice(candidates, 1, 0), lambda kept, c: F.when((F.size(kept) >= m) | F.exists(kept, lambda s: distance(s["vec"], c["vec"]) < 1.0 - c["score"]), kept).otherwise(F.concat(kept, F.array(c)))),
        1,
        m,
    )


def recall(approximate: DataFrame, exact: DataFrame, record_id: str, k: int = 10) -> DataFrame:
    """One row: mean, least and 5th percentile (nearest rank) of the share of exact neighbours found."""
    a = approximate.groupBy("query_id").agg(F.collect_set(record_id).alias("a"))
    e = exact.groupBy("query_id").agg(F.collect_set(record_id).alias("e"))
    r = e.join(a, "query_id", "left").select((F.size(F.array_intersect("e", F.coalesce("a", F.array().cast("array<bigint>")))) / F.lit(float(k))).alias("r"))
    rank = F.element_at(F.sort_array(F.collect_list("r")), F.least(F.floor(F.count("*") * 5 / 100), F.count("*") - 1).cast("int") + 1)
    return r.agg(F.round(F.avg("r"), 6).alias("mean"), F.round(F.min("r"), 6).alias("least"), F.round(rank, 6).alias("p5"))
