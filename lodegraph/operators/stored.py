"""The stored index: what a search reads instead of the texts. Built once, written to a folder, loaded by any session."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources.files import load_index, save_index
from . import bm25, vector

DIM = 384


def build_index(chunks: DataFrame, vectors: DataFrame, dim: int = DIM) -> dict[str, DataFrame]:
    """The tables of a search index: chunks (each id once), postings, term_df, corpus_stats, vectors by cell, cells.

    The texts are moved once, here, to drop repeats; no search moves them again.
    """
    one = chunks.where("id is not null").dropDuplicates(["id"])
    words = bm25.index_tables(one.select(F.col("id").alias("chunk_id"), "content"), "chunk_id", "content")
    v = vectors.where("chunk_id is not null")
    centres = vector.fit_cells(v, "chunk_id", "vec", dim)
    cells = chunks.sparkSession.createDataFrame([(i, x.tolist()) for i, x in enumerate(centres)], "cell int, centre array<double>")
    return {"chunks": one, **words, "vectors": vector.in_cells(v, "chunk_id", "vec", centres), "cells": cells}


def ensure_index(spark: SparkSession, chunks: DataFrame, vectors: DataFrame) -> dict[str, DataFrame]:
    """The stored index of two tables, built in the shared folder if this session has not built it from the same files."""
    jvm = spark.sparkContext._jvm
    key = []
    for f in sorted([*chunks.inputFiles(), *vectors.inputFiles()]):
        path = jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        key.append(f"{f}:{status.getLen()}:{status.getModificationTime()}")
    name = f"{spark.sparkContext.applicationId}-{hashlib.md5(repr(key).encode()).hexdigest()}"
    folder = f"{shared_folder(spark)}/index-{name}"
    done = jvm.org.apache.hadoop.fs.Path(f"{folder}/vectors/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        save_index(build_index(chunks, vectors), folder)
    return load_index(spark, folder)
