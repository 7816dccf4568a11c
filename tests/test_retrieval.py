import math
import random

import pytest

from lodegraph.functions.text import query_terms
from lodegraph.operators import bm25, fusion, vector

DOCS = [(1, "retry backoff http"), (2, "retry retry socket"), (3, "the cat"), (4, None), (5, "")]


def brute(docs, query):
    toks = {i: [w for w in (t or "").split() if w not in ("the",)] for i, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    out = {}
    for i, ts in toks.items():
        s = 0.0
        for q in query_terms(query):
            df, tf = sum(q in x for x in toks.values()), ts.count(q)
            if tf:
                s += max(0, math.log((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / avg))
        if s > 0:
            out[i] = round(s, 6)
    return out


def test_both_ways_to_score_agree(spark):
    d = spark.createDataFrame(DOCS, "id long, text string")
    want = brute(DOCS, "retry socket")
    scan = {r["id"]: round(r["score"], 6) for r in bm25.score_scan(d, "id", "text", "retry socket").collect()}
    t = bm25.tokenized(d, "id", "text")
    post, lengths = bm25.postings(t, "id"), bm25.doc_lengths(t, "id")
    q = spark.createDataFrame([(7, "retry"), (7, "socket")], "query_id int, term string")
    index = {r["id"]: round(r["score"], 6) for r in bm25.score_index(post, bm25.term_df(post), lengths, bm25.corpus_stats(lengths), q, "id").collect()}
    assert scan == want == index
    assert bm25.score_scan(d, "id", "text", "the").count() == 0
    assert bm25.score_scan(d.limit(0), "id", "text", "retry").count() == 0
    assert [r["id"] for r in bm25.top(bm25.score_scan(d, "id", "text", "retry"), "id", 1).collect()] == [2]
    assert bm25.without(d, spark.createDataFrame([(2,)], "id long"), "id").count() == 4


def test_idf_is_never_negative(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(bm25.idf(F.lit(1.0), F.lit(3.0))).collect()[0][0] == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, 9.0), (2, 8.0)], "chunk_id long, score double")
    b = spark.createDataFrame([(2, 0.9), (3, 0.8)], "chunk_id long, score double")
    r = {x["chunk_id"]: (x["score"], x["signal"]) for x in fusion.reciprocal_rank_fusion(a, b, "chunk_id").collect()}
    assert r[2] == (pytest.approx(1 / 62 + 1 / 61, abs=1e-9), "HYBRID")
    assert r[1] == (pytest.approx(1 / 61, abs=1e-9), "KW") and r[3] == (pytest.approx(1 / 62, abs=1e-9), "SEM")


def test_overlaps_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, f"f{rng.randint(0, 2)}", (s := rng.randint(1, 40)), s + rng.randint(0, 20), round(rng.random(), 2)) for i in range(80)]
    got = {r["chunk_id"] for r in fusion.suppress_overlaps(spark.createDataFrame(rows, "chunk_id long, file_path string, line_start int, line_end int, score double"), "chunk_id").collect()}
    kept = []
    for i, f, s, e, sc in sorted(rows, key=lambda r: (-r[4], r[0])):
        def share(k):
            short = min(k[3] - k[2], e - s)
            return max(0, min(k[3], e) - max(k[2], s)) / short if short > 0 else 0
        if not any(k[1] == f and share(k) > 0.5 for k in kept):
            kept.append((i, f, s, e, sc))
    assert got == {k[0] for k in kept}


def test_nearest_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.integers(-3, 4, (60, 5)).astype(float)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(100, None), (101, [1.0]), (102, [0.0] * 5), (None, [1.0] * 5)]
    d = spark.createDataFrame(rows, "id long, v array<float>")
    q = [(1, [1.0, 2, 3, 4, 5]), (2, [0.0, 1, 0, 0, 1])]
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in vector.nearest(d, "id", "v", q, 7).collect()}
    for qid, v in q:
        s = sorted(((round(float(np.dot(x, v) / np.linalg.norm(x) / np.linalg.norm(v)), 6), i) for i, x in enumerate(m) if x.any()), key=lambda t: (-t[0], t[1]))[:7]
        assert [got[qid, k + 1] for k in range(7)] == [(i, sc) for sc, i in s]
    assert vector.nearest(d.limit(0), "id", "v", q, 3).count() == 0


def test_vector_expressions(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([([3.0, 4.0],)], "v array<double>")
    assert d.select(vector.normalize(F.col("v"))).collect()[0][0] == pytest.approx([0.6, 0.8])
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(vector.distance(F.col("v"), F.col("v"))).collect()[0][0]
    assert zero == 1.0
    with pytest.raises(Exception, match="dimension"):
        d.select(vector.require_dimension(F.col("v"), 3)).collect()
    c = spark.createDataFrame([([(0.9, 1, [1.0, 0.0]), (0.8, 2, [0.99, 0.14]), (0.5, 3, [0.0, 1.0])],)], "c array<struct<score: double, id: int, vec: array<double>>>")
    assert [x["id"] for x in c.select(vector.diverse(F.col("c"), 5)).collect()[0][0]] == [1, 3]


def test_recall(spark):
    a = spark.createDataFrame([(1, 1), (1, 2)], "query_id int, id long")
    e = spark.createDataFrame([(1, 1), (1, 3)], "query_id int, id long")
    assert tuple(vector.recall(a, e, "id", 2).collect()[0]) == (0.5, 0.5, 0.5)


def test_stored_index_answers_as_a_scan(spark, tmp_path):
    from lodegraph.operators import stored
    from lodegraph.sources import files

    texts = {i: " ".join(w for w, n in (("ledger", i % 3), ("socket", i % 5), ("retry", i % 2)) for _ in range(n)) for i in range(40)}
    chunks = spark.createDataFrame([(i, f"/r/{i % 4}.rs", i, i + 1, "rs", "Function", t) for i, t in texts.items() for _ in range(1 + (i % 7 == 0))], "id long, file_path string, line_start int, line_end int, language string, chunk_type string, content string")
    rng = random.Random(2)
    vectors = spark.createDataFrame([(i, i, [rng.gauss(0, 1) for _ in range(384)]) for i in texts] + [(90, 90, None), (91, 91, [0.0] * 384)], "embedding_id long, chunk_id long, vec array<float>")
    files.save_index(stored.build_index(chunks, vectors), str(tmp_path))
    index = files.load_index(spark, str(tmp_path))
    for q in ("ledger retry", "socket", "the", "unheard"):
        a = bm25.search_index(index, q, "chunk_id", 10).collect()
        b = bm25.top(bm25.score_scan(chunks.withColumnRenamed("id", "chunk_id"), "chunk_id", "content", q), "chunk_id", 10).collect()
        assert a == b
        one, two = fusion.search_index(index, q).select("chunk_id", "score", "signal"), fusion.search(chunks, vectors, q).select("chunk_id", "score", "signal")
        assert one.collect() == two.collect()
    plan = bm25.search_index(index, "ledger retry", "chunk_id", 10)._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan and "content" not in plan


def test_cells_and_blocks(spark):
    import numpy as np

    from lodegraph.operators import stored  # noqa: F401

    rng = np.random.default_rng(5)
    middle = rng.normal(size=(12, 16))
    m = np.concatenate([c + 0.3 * rng.normal(size=(40, 16)) for c in middle])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(900, None), (901, [0.0] * 16), (902, [1.0])], "id long, v array<float>")
    centres = vector.fit_cells(d, "id", "v", 16)
    cells = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    stored_rows = vector.in_cells(d, "id", "v", centres)
    assert stored_rows.select("id").distinct().count() == 480
    q = d.where("id % 50 = 0 and size(v) = 16")
    exact = vector.nearest_in_blocks(d, "id", "v", q, "id", "v", 10, block=3)
    assert exact.groupBy("query_id").count().where("count = 10").count() == 10
    got = vector.probe_in_cells(stored_rows, cells, "id", q, "id", "v", 10, probes=4)
    assert vector.recall(got, exact, "id").collect()[0]["mean"] >= 0.9
    one = q.first()
    few = vector.search_cells(stored_rows, cells, "id", [(one["id"], list(one["v"]))], 10, probes=22)
    assert [r["id"] for r in few.orderBy("rank").collect()] == [r["id"] for r in exact.where(f"query_id = {one['id']}").orderBy("rank").collect()]
