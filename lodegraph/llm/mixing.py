"""Mixing sources to target weights by entropy balancing.

Each document gets a rate between 0 and its source's cap. Under the entropy of capped rates the balancing weights are
rate = cap * sigmoid(eta + lambda * size): exponentially tilted by the document's tokens. For each source the convex dual

    D(b) = cap * sum_i log(1 + exp(eta + b * size_i)) - b * tokens

is solved by damped Newton steps. ``eta`` is the same for all sources: it is the rate at which the untilted corpus gives
the wanted total, so the result is the mix nearest to the corpus itself (in relative entropy) that meets every source's
tokens. With ``keep_size`` a second constraint holds the mean size of a source's documents and ``eta`` becomes a dual
variable too; then no length is favoured and the tilt vanishes. Gradient and Hessian are sums over documents; documents
of one source and size are alike, so the workers add up once how many there are of each size and every Newton step is a
small distributed aggregate over that table. A source of any size thus costs no shuffle of its documents.

Rates become copies by threshold: a document gets floor(rate) copies, and one more if a hash of its id falls below the
fraction; the threshold is then moved, by source, until the tokens meet the goal as nearly as whole documents can.

Shares: sources without documents give nothing, and their share is spread evenly over the others (the nearest point of
the simplex in the largest, the absolute and the squared deviation). The total is the largest at which every share can
still be met under the caps.

Defined results
* null and blank texts, and sources without a target, have no part; sources are matched in repaired spelling.
* a target that is null, negative or zero, or max_repeats null or below 1, asks for nothing of its source.
* repeated rows (same id and text) count once; ties in the hash go by id; empty tables give the targets with zero shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import clean_name

#: The public tokenizer that sizes are measured in; a parameter of every operator here.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
NEWTON_STEPS, TOLERANCE, BINS, REFINEMENTS = 40, 1e-9, 4096, 2

_TOKENIZERS: dict[str, object] = {}


def _count(texts: list[str], path: str) -> list[int]:
    t = _TOKENIZERS.get(path)
    if t is None:
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        t = _TOKENIZERS[path] = Tokenizer.from_file(path)
        t.encode_special_tokens = True
    out: list[int] = []
    for i in range(0, len(texts), 256):  # bounds the memory that encodings take
        out += [len(e.ids) for e in t.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]
    return out


def _sizes(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": _count(list(b["text"]), path)})


def document_sizes(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of documents whose source has a target; written once to the shared folder."""
    d = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != ""))
    d = d.select(F.col("doc_id").cast("long").alias("doc_id"), clean_name(F.col("source")).alias("source"), "text")
    d = d.join(targets.select("source").distinct(), "source", "left_semi")
    s = d.select("doc_id", "source", "text").mapInPandas(partial(_sizes, path=tokenizer), "doc_id long, source string, n_tokens int")
    return cut(s.where("n_tokens > 0").dropDuplicates(["doc_id", "source"]))


def clean_targets(mix_targets: DataFrame) -> DataFrame:
    """One row a source: (source, target_share, max_repeats); of several rows the largest values count."""
    t = mix_targets.where("source is not null").select(clean_name(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int"))
    t = t.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    return t.select("source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))


class Goal:
    """What one source must give: tokens and documents (as rates), and the dual variables that do it."""

    __slots__ = ("source", "target", "cap", "docs", "tokens", "scale", "want_tokens", "want_docs", "a", "b", "full", "threshold")

    def __init__(self, source: str, target: float, cap: int, docs: int, tokens: int) -> None:
        self.source, self.target, self.cap, self.docs, self.tokens = source, target, cap, docs, tokens
        self.scale = tokens / docs if docs else 1.0
        self.want_tokens = self.a = self.b = 0.0
        self.want_docs: float | None = None
        self.full, self.threshold = False, 0.0


def goals(rows: list[tuple[str, float, int, int, int]], keep_size: bool = False) -> list[Goal]:
    """Goals from (source, target_share, max_repeats, documents, tokens)."""
    g = [Goal(*r) for r in rows]
    live = [x for x in g if x.tokens > 0 and x.cap > 0 and x.target > 0]
    if not live:
        return g
    lost = max(0.0, 1.0 - sum(x.target for x in live))
    share = {x.source: x.target + lost / len(live) for x in live}
    whole = sum(share.values())
    total = min(x.cap * x.tokens / (share[x.source] / whole) for x in live)
    for x in live:
        x.want_tokens = total * share[x.source] / whole
        fraction = x.want_tokens / (x.cap * x.tokens)
        x.full = fraction >= 1 - 1e-9
        if keep_size:
            x.want_docs = x.cap * x.docs * min(fraction, 1.0)
    usual = min(0.999, total / sum(x.cap * x.tokens for x in live))
    for x in live:
        x.a = float(np.log(usual / (1 - usual)))
    return g


def newton(table: DataFrame, g: list[Goal], steps: int = NEWTON_STEPS) -> int:
    """Solves every source's dual over ``table`` (source, n_tokens, n); the number of steps taken."""
    open_ = [x for x in g if x.want_tokens > 0 and not x.full]
    for step in range(steps):
        if not open_:
            return step
        spark = table.sparkSession
        state = spark.createDataFrame([(x.source, x.a, x.b, x.scale) for x in open_], "source string, a double, b double, scale double")
        z = F.col("n_tokens") / F.col("scale")
        p = 1.0 / (1.0 + F.exp(-(F.col("a") + F.col("b") * z)))
        n = F.col("n").cast("double")
        got = (
            table.join(F.broadcast(state), "source")  # one row a source with a target
            .groupBy("source")
            .agg(F.sum(n * p).alias("s0"), F.sum(n * p * z).alias("s1"), F.sum(n * p * (1 - p)).alias("h0"), F.sum(n * p * (1 - p) * z).alias("h1"), F.sum(n * p * (1 - p) * z * z).alias("h2"))
        )
        still = []
        by = {x.source: x for x in open_}
        for r in got.collect():
            x = by[r["source"]]
            g0 = 0.0 if x.want_docs is None else x.want_docs - x.cap * r["s0"]
            g1 = x.want_tokens / x.scale - x.cap * r["s1"]
            if abs(g0) <= TOLERANCE * max(1.0, x.want_docs or 0.0) and abs(g1) <= TOLERANCE * max(1.0, x.want_tokens / x.scale):
                continue
            h0, h1, h2 = (x.cap * r[k] for k in ("h0", "h1", "h2"))
            det = h0 * h2 - h1 * h1
            if x.want_docs is None:
                da, db = 0.0, g1 / max(h2, 1e-300)
            elif det > 1e-12 * max(h0 * h2, 1e-300):
                da, db = (h2 * g0 - h1 * g1) / det, (h0 * g1 - h1 * g0) / det
            else:  # all documents of one size: the two constraints are one
                da, db = g0 / max(h0, 1e-300), 0.0
            size = max(abs(da), abs(db))
            damp = min(1.0, 2.0 / size) if size else 1.0
            x.a += damp * da
            x.b += damp * db
            if size > 1e-12:
                still.append(x)
        open_ = still
    return steps


def _rates(sizes: DataFrame, g: list[Goal]) -> DataFrame:
    state = sizes.sparkSession.createDataFrame(
        [(x.source, x.a, x.b, x.scale, float(x.cap), x.full, x.threshold) for x in g if x.want_tokens > 0], "source string, a double, b double, scale double, cap double, full boolean, threshold double"
    )
    d = sizes.join(F.broadcast(state), "source")
    rate = F.when(F.col("full"), F.col("cap")).otherwise(F.col("cap") / (1.0 + F.exp(-(F.col("a") + F.col("b") * F.col("n_tokens") / F.col("scale")))))
    d = d.withColumn("rate", rate)
    fraction = F.col("rate") - F.floor("rate")
    # in (-1, 1): below the threshold the document gets its further copy; zero is unbiased rounding
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)).cast("double") / float(1 << 52)
    return d.withColumn("key", F.when(fraction > 0, u - fraction))


def thresholds(sizes: DataFrame, g: list[Goal]) -> None:
    """Moves each source's threshold until its tokens meet the goal; two passes over BINS bins a source each."""
    live = [x for x in g if x.want_tokens > 0]
    lo = {x.source: -1.0 for x in live}
    hi = {x.source: 1.0 for x in live}
    base: dict[str, float] = {}
    for turn in range(REFINEMENTS):
        r = _rates(sizes, g)
        span = sizes.sparkSession.createDataFrame([(x.source, lo[x.source], hi[x.source]) for x in live], "source string, lo double, hi double")
        r = r.join(F.broadcast(span), "source")
        k = F.when(F.col("key").isNull(), F.lit(-2)).when(F.col("key") < F.col("lo"), F.lit(-1)).when(F.col("key") >= F.col("hi"), F.lit(BINS)).otherwise(F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS))
        sums = r.groupBy("source", k.cast("int").alias("bin")).agg(F.sum("n_tokens").alias("t"), F.sum(F.floor("rate") * F.col("n_tokens")).alias("whole")).collect()
        for x in live:
            mine = [s for s in sums if s["source"] == x.source]
            have = float(sum(s["whole"] for s in mine)) + float(sum(s["t"] for s in mine if s["bin"] == -1))
            at, width = 0, (hi[x.source] - lo[x.source]) / BINS
            bins = {s["bin"]: float(s["t"]) for s in mine if 0 <= s["bin"] < BINS}
            for at in range(BINS):
                t = bins.get(at, 0.0)
                if have + t > x.want_tokens:
                    break
                have += t
            base[x.source] = have
            low = lo[x.source] + at * width
            if turn == REFINEMENTS - 1:
                x.threshold = low if x.want_tokens - have <= bins.get(at, 0.0) / 2 else low + width
            else:
                lo[x.source], hi[x.source] = low, low + width


def mix_copies(documents: DataFrame, mix_targets: DataFrame, tokenizer: str = TOKENIZER, keep_size: bool = False) -> tuple[DataFrame, DataFrame, list[Goal]]:
    """Documents with their rate and copies, the cleaned targets, and the goals."""
    targets = clean_targets(mix_targets)
    sizes = document_sizes(documents, targets, tokenizer)
    table = cut(sizes.groupBy("source", "n_tokens").agg(F.count("*").alias("n")))
    have = table.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"))
    rows = targets.join(have, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("docs", F.lit(0)), F.coalesce("tokens", F.lit(0))).orderBy("source").collect()
    g = goals([tuple(r) for r in rows], keep_size)
    newton(table, g)
    thresholds(sizes, g)
    r = _rates(sizes, g)
    more = F.when(F.col("key").isNotNull() & (F.col("key") < F.col("threshold")), 1).otherwise(0)
    copies = (F.floor("rate") + more).cast("int")
    return r.select("doc_id", "source", "n_tokens", F.round("rate", 6).alias("rate"), copies.alias("copies")), targets, g


def mix_documents(documents: DataFrame, mix_targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens, rate, copies): the chosen documents, each with how often it is taken."""
    return mix_copies(documents, mix_targets, tokenizer)[0].where("copies > 0")


def mix_report(documents: DataFrame, mix_targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row a source: target and actual share, documents, tokens, and how often the most repeated document is taken."""
    copies, targets, _ = mix_copies(documents, mix_targets, tokenizer)
    by = copies.groupBy("source").agg(
        F.count("*").alias("n_documents"), F.sum(F.col("n_tokens").cast("long")).alias("tokens_available"), F.sum((F.col("copies") > 0).cast("long")).alias("n_chosen"),
        F.sum(F.col("copies").cast("long") * F.col("n_tokens")).alias("tokens_taken"), F.max("copies").alias("most_repeats"),
    )
    total = by.agg(F.sum("tokens_taken").alias("total"))
    r = targets.join(by, "source", "left").join(F.broadcast(total))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    share = F.coalesce(F.round(F.col("tokens_taken") / F.nullif(F.col("total"), F.lit(0)), 6), F.lit(0.0)).alias("actual_share")
    return r.select("source", "target_share", share, "max_repeats", zero("most_repeats"), zero("n_documents"), zero("n_chosen"), zero("tokens_available"), zero("tokens_taken"))
