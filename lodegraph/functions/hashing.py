"""The hash-projection embedding, in native expressions and on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import embedding_tokens

DIM = 384
# Hashing this long first leaves the generator in the state of seed 0, 1 and 2.
_SEEDS = (-365884300664092260, -7682426122119481604, -4733188169505733816)


def seeded_hash(col: Column, seed: int) -> Column:
    """The 64-bit xx hash of a string under seed 0, 1 or 2: the built-in chains columns, and its first step can be inverted."""
    return F.xxhash64(F.lit(_SEEDS[seed]).cast("bigint"), col)


def unsigned_mod(h: Column, n: int) -> Column:
    """``h`` as an unsigned 64-bit number, modulo ``n``."""
    return F.pmod(F.pmod(h, F.lit(n)) + F.when(h < 0, pow(2, 64, n)).otherwise(0), F.lit(n))


def sparse_embedding(df: DataFrame, record_id: str, text: str, dim: int = DIM) -> DataFrame:
    """(record_id, pos, value): the normalised embedding's entries that are not zero.

    Each token adds a sign at two positions. Tokens are counted per text before they are hashed, and positions are added
    up by text, so the shuffle moves sums, not tokens.
    """
    t = df.select(F.col(record_id).alias("id"), F.explode(embedding_tokens(F.col(text))).alias("token"))
    h0, h1, h2 = (seeded_hash(F.col("token"), k) for k in range(3))
    sign = lambda bit: F.when(h2.bitwiseAND(bit) != 0, -1.0).otherwise(1.0)
    two = F.array(F.struct(unsigned_mod(h0, dim).alias("pos"), sign(1).alias("v")), F.struct(unsigned_mod(h1, dim).alias("pos"), sign(2).alias("v")))
    s = t.select("id", F.explode(two).alias("e")).groupBy("id", F.col("e.pos").cast("int").alias("pos")).agg(F.sum("e.v").alias("v")).where("v <> 0")
    norm = s.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return s.join(norm, "id").select(F.col("id").alias(record_id), "pos", (F.col("v") / F.col("norm")).alias("value"))


def embed(df: DataFrame, record_id: str, text: str, dim: int = DIM) -> DataFrame:
    """(record_id, vec): dense embeddings; a text without tokens has the zero vector."""
    s = sparse_embedding(df, record_id, text, dim)
    m = s.groupBy(record_id).agg(F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("m"))
    d = df.select(record_id).distinct().join(m, record_id, "left")
    zero = F.coalesce("m", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<double>")))
    return d.select(record_id, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(zero, i), F.lit(0.0))).alias("vec"))


def embed_text(text: str, dim: int = DIM) -> list[float]:
    """The embedding of one string, for queries."""
    import re

    import numpy as np
    import xxhash

    low = "".join(c if c.isalnum() or c == "_" else " " for c in text.lower())
    acc = np.zeros(dim)
    for w in re.split(r"\s+", low):
        if len(w.encode()) < 2:
            continue
        for t in [w, *(p for p in w.split("_") if len(p.encode()) >= 2)] if "_" in w else [w]:
            h0, h1, h2 = (xxhash.xxh64_intdigest(t, k) for k in range(3))
            acc[h0 % dim] += -1 if h2 & 1 else 1
            acc[h1 % dim] += -1 if h2 & 2 else 1
    n = float(np.linalg.norm(acc))
    return (acc / n).tolist() if n > 1e-8 else acc.tolist()
