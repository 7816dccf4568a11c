"""Incremental indexing: a feed of file changes kept up in a stored table of files or chunks.

A change replaces what the table has of its path. Within a batch the last change of a path counts; across batches the
newest time wins, so late rows and replays change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.languages import language_of
from ..functions.text import clean_path
from ..operators import chunking, graph_build
from ..session import cut

FEED = "seq long, path string, op string, content string, ts timestamp, received_at timestamp"


def clean_op(op: Column) -> Column:
    """create, modify or delete in any usual spelling; null for anything else."""
    o = F.lower(F.trim(op))
    return F.when(o.rlike("^(create|add)"), "create").when(o.rlike("^(modif|change|update|write)"), "modify").when(o.rlike("^(delet|remov|unlink)"), "delete")


def clean_feed(feed: DataFrame) -> DataFrame:
    """One row a seq, paths in one notation, operations in one spelling, the event's time or else the time of receipt."""
    f = feed.where("path is not null").withColumns({"op": clean_op(F.col("op")), "path": F.regexp_replace(F.regexp_replace(clean_path(F.trim("path")), r"/\./", "/"), "/{2,}", "/"), "at": F.coalesce("ts", "received_at")})
    return f.where("op is not null").dropDuplicates(["seq"])


def latest(feed: DataFrame) -> DataFrame:
    """(path, op, content, at, seq): the last change of every path. Equal times go by seq. Partial maxima come before the
    shuffle, so a path with a third of all changes is one row a task."""
    f = clean_feed(feed)
    last = F.max(F.struct("at", "seq", "op", "content")).alias("l")
    return f.groupBy("path").agg(last).select("path", "l.op", "l.content", "l.at", "l.seq")


def live_content(feed: DataFrame) -> DataFrame:
    """(path, content, at): files that exist after all changes, with the last content a change brought."""
    f = clean_feed(feed)
    last = F.max(F.struct("at", "seq", "op")).alias("l")
    gone = F.max(F.when(F.col("op") == "delete", F.struct("at", "seq"))).alias("gone")
    body = F.max(F.when(F.col("content").isNotNull(), F.struct("at", "seq", "content"))).alias("b")
    g = f.groupBy("path").agg(last, gone, body).where("l.op <> 'delete'")
    fresh = F.col("gone").isNull() | (F.struct("b.at", "b.seq") > F.col("gone"))
    return g.select("path", F.when(fresh, F.col("b.content")).alias("content"), F.col("l.at").alias("at"))


def apply_changes(current: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The table (path, op, content, at, seq) after a batch; deleted paths stay as marks, so a late row cannot revive them."""
    new = latest(batch)
    if current is None:
        return new
    both = current.unionByName(new)
    last = F.max(F.struct("at", "seq", "op", "content")).alias("l")
    return both.groupBy("path").agg(last).select("path", "l.op", "l.content", "l.at", "l.seq")


def stored_changes(spark: SparkSession, table: str) -> DataFrame:
    """(path, op, content, at, seq, v): the newest state of every path in a stored table of changes, with the batch it came in.

    The table is a list of batches (``v=N``), each with its own last change a path; a reader takes the newest of a path.
    """
    last = F.max(F.struct("at", "seq", "op", "content", "v")).alias("l")
    return spark.read.parquet(table).groupBy("path").agg(last).select("path", "l.op", "l.content", "l.at", "l.seq", "l.v")


def upsert_stream(spark: SparkSession, source: str, table: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None, every: str | None = None, files: int | None = None):
    """A streaming query that keeps ``table`` (Parquet, one folder a batch) up with the change files in ``source``.

    A batch adds its own last changes only, so its cost is its size, not the table's; a replayed batch writes the same
    folder again. ``compact`` folds the folders together. ``on_batch`` gets the batch's latest changes, to re-chunk or
    re-embed their files. ``every``: the interval between batches; without one all that is there is read, then it ends.
    """
    reader = spark.readStream.schema(FEED)
    feed = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)

    def merge(batch: DataFrame, number: int) -> None:
        new = cut(latest(batch))
        new.write.mode("overwrite").parquet(f"{table}/v={number}")
        if on_batch:
            on_batch(new, number)

    w = feed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def compact(spark: SparkSession, table: str, into: str) -> None:
    """The newest state of every path as a table of one folder, at the place ``into``. Deleted paths stay as marks, so a late
    row cannot revive them. The old table is left for those who read it; switching over is the caller's step."""
    now = stored_changes(spark, table)
    v = now.agg(F.max("v")).first()[0] or 0
    now.drop("v").write.mode("overwrite").parquet(f"{into}/v={v}")


def index_stream(spark: SparkSession, source: str, folder: str, checkpoint: str, every: str | None = None, files: int | None = None):
    """As ``upsert_stream``, with the index of the changed files: their chunks, hash embeddings (sparse), nodes and edges are
    made anew batch by batch, in tables of the same form beside ``changes``. ``current`` reads them."""

    def refresh(new: DataFrame, number: int) -> None:
        f = new.where("op <> 'delete' and content is not null").select("path", language_of(F.col("path")).alias("language"), "content").where("language is not null")
        chunks = cut(chunking.with_ids(chunking.chunk_files(f)))
        nodes, edges = graph_build.build_graph(f)
        path = nodes.select(F.col("id").alias("src"), F.col("file_path").alias("path"))
        parts = {"chunks": chunks, "embeddings": hashing.sparse_embedding(chunks, "id", "content").join(chunks.select("id", "path").distinct(), "id"), "nodes": nodes.withColumn("path", F.col("file_path")), "edges": edges.join(path, "src")}
        for name, df in parts.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}/v={number}")

    return upsert_stream(spark, source, f"{folder}/changes", checkpoint, refresh, every, files)


def current(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of ``index_stream`` as it stands: of every path the rows of the batch that brought its newest change."""
    live = stored_changes(spark, f"{folder}/changes").where("op <> 'delete'").select("path", "v")
    return spark.read.parquet(f"{folder}/{name}").join(live, ["path", "v"], "left_semi").drop("v")


def change_counts(feed: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Changes by operation in tumbling windows of event time; works on streams (late rows beyond ``late`` are dropped there)."""
    f = feed.where("ts is not null").withColumn("op", clean_op(F.col("op")))
    if f.isStreaming:
        f = f.withWatermark("ts", late)
    return f.groupBy(F.window("ts", window).alias("w"), "op").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "op", "n")
