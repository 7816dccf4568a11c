"""Recall of the nearest-vector search against brute force: ``python -m lodegraph.llm.recall DIR``.

The queries are all vectors whose id is divisible by 50, against all rows. Prints one JSON line: queries, true pairs, pairs
found, recall, precision, and the lengths of the arrays.
"""

from __future__ import annotations

import json
import sys

import numpy as np
import pyarrow.parquet as pq

from . import nearest


def brute_force(ids: np.ndarray, m: np.ndarray, k: int = nearest.K, least: float = nearest.MIN_SIMILARITY) -> set[tuple[int, int]]:
    """(query, neighbour) for the queries, by exact cosines rounded to 6 decimals, ties by id."""
    u = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    single = u.astype(np.float32)
    queries = np.flatnonzero(ids % 50 == 0)
    out = set()
    for i in range(0, len(queries), 256):
        q = queries[i : i + 256]
        s = single[q] @ single.T
        s[np.arange(len(q)), q] = -1
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        for j, row in enumerate(q):
            c = np.flatnonzero(s[j] >= max(kth[j] - 1e-5, least - 1e-5))
            exact = np.rint(u[c] @ u[row] * 1e6).astype(np.int64)
            c, exact = c[exact >= least * 1e6], exact[exact >= least * 1e6]
            out |= {(int(ids[row]), int(ids[x])) for x in c[np.lexsort((ids[c], -exact))[:k]]}
    return out


def main(folder: str) -> None:
    from ..session import get_session
    from .common import table

    t = pq.read_table(f"{folder}/vectors.parquet", columns=["embedding_id", "vec"])
    rows, m = nearest.matrix_of(t.column("vec"), nearest.DIM)
    ids = t.column("embedding_id").to_numpy()[rows]
    want = brute_force(ids, m)
    directions = nearest.Directions((m / np.linalg.norm(m, axis=1, keepdims=True))[np.random.default_rng(1).permutation(len(m))[: nearest.SAMPLE]], len(m))
    some = m[:: max(1, len(m) // 20_000)]
    lengths = np.bincount((directions.signatures(some / np.linalg.norm(some, axis=1, keepdims=True))[:, : directions.tails] >> 4).ravel(), minlength=directions.count) * (len(m) / len(some))
    spark = get_session("recall", "local[8]", 24)
    spark.sparkContext.setLogLevel("ERROR")
    got = {(r["id"], r["neighbour"]) for r in nearest.nearest_vectors(table(spark, folder, "vectors")).where("id % 50 = 0").toLocalIterator()}
    print(json.dumps({"queries": int((ids % 50 == 0).sum()), "true": len(want), "found": len(got), "recall": round(len(got & want) / max(1, len(want)), 4), "precision": round(len(got & want) / max(1, len(got)), 4), "directions": directions.count, "longest array": int(lengths.max()), "mean array": int(lengths.mean())}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1])
