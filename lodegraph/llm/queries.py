"""The queries of the problems on training data, each over its whole tables. ``pN_`` belongs to problem N."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import credentials, docpairs, leakage, machine_files, mixing, nearest, splitting, subjects
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    chunks = credentials.credential_lines(table(spark, sf, "chunks"), "chunk", "id", "content", "line_start")
    return chunks.unionByName(credentials.issue_lines(table(spark, sf, "security_issues")))


def p1_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """(record_type, record_id, n_values, redacted) of chunks and of the scanner's snippets."""
    c = credentials.redact(table(spark, sf, "chunks"), "id", "content").select(F.lit("chunk").alias("record_type"), "*")
    i = credentials.redact(table(spark, sf, "security_issues"), "issue_id", "snippet", snippets=True).select(F.lit("issue").alias("record_type"), "*")
    return c.unionByName(i).dropDuplicates(["record_type", "record_id", "redacted"])


def p1_spans(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.absolute_spans(table(spark, sf, "chunks"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return machine_files.classify_files(table(spark, sf, "chunks")).where("reason is not null").select("file_path")


def p2_files(spark: SparkSession, sf: str) -> DataFrame:
    f = machine_files.classify_files(table(spark, sf, "chunks"), table(spark, sf, "ignore_patterns"))
    return f.select("file_path", "reason", "ignored", "by_prints", "n_prints", "n_recurring", "n_known")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return nearest.similar_pairs(table(spark, sf, "vectors"))


def p3_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return nearest.nearest_vectors(table(spark, sf, "vectors"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf, "chunks")).select("chunk_id").distinct()


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf, "chunks"))


def p4_rejoined(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of every oversized chunk put together again, overlaps left out, and whether all keep the limits."""
    p = p4_pieces(spark, sf)
    own = F.struct("piece_no", F.expr("substr(text, overlap_chars + 1)").alias("own"))
    g = p.groupBy("chunk_id", "version").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["own"]), "").alias("whole"), F.max("n_words").alias("w"), F.max("n_bytes").alias("b"), F.count("*").alias("n")
    )  # a group is the pieces of one text
    kept = (F.col("w") <= splitting.MAX_WORDS) & (F.col("b") <= splitting.MAX_BYTES) & (F.col("n") > 1)
    return g.select("chunk_id", F.md5("whole").alias("digest"), kept.alias("within_limits"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return docpairs.documented(table(spark, sf, "chunks"))


def p5_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return docpairs.doc_pairs(table(spark, sf, "chunks")).dropDuplicates(["chunk_id", "name", "start"])


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_mix_report(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p7_mix_documents(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p7_mix_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """(source, n_documents, within_cap, near): whether the repeats keep the cap and the share is within 0.005 of the reachable
    one (the target, with an even part of what sources without documents leave)."""
    r = mixing.mix_report(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))
    has = F.col("n_documents") > 0
    left = r.agg(F.sum(F.when(~has, F.col("target_share")).otherwise(0.0)).alias("left"), F.count_if(has).alias("k"))
    near = F.abs(F.col("actual_share") - F.when(has, F.col("target_share") + F.col("left") / F.col("k")).otherwise(0.0)) <= 0.005
    return r.join(F.broadcast(left)).select("source", "n_documents", (F.col("most_repeats") <= F.col("max_repeats")).alias("within_cap"), near.alias("near"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.document_subjects(table(spark, sf, "documents"), table(spark, sf, "subjects"), table(spark, sf, "subject_labels")).select("doc_id", "subject")


def p8_mixtures(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.document_subjects(table(spark, sf, "documents"), table(spark, sf, "subjects"), table(spark, sf, "subject_labels"))


def p8_composition(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.composition(p8_mixtures(spark, sf))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found, "p1_redacted": p1_redacted, "p1_spans": p1_spans,
        "p2_found": p2_found, "p2_files": p2_files,
        "p3_found": p3_found, "p3_neighbours": p3_neighbours,
        "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_rejoined": p4_rejoined,
        "p5_found": p5_found, "p5_pairs": p5_pairs,
        "p6_found": p6_found, "p6_leaks": p6_leaks,
        "p7_mix_report": p7_mix_report, "p7_mix_documents": p7_mix_documents, "p7_mix_bounds": p7_mix_bounds,
        "p8_found": p8_found, "p8_mixtures": p8_mixtures, "p8_composition": p8_composition,
    }


def oracle_sql() -> dict[str, str]:
    """Where plain SQL can say it; the others are tested against brute force, round trips or held-out labels."""
    return {
        "p4_found": r"""
            SELECT DISTINCT id AS chunk_id FROM chunks
            WHERE id IS NOT NULL AND (strlen(content) > 4096 OR len(regexp_extract_all(content, '[^ \t\r\n]+')) > 400)""",
        "p4_rejoined": r"""
            SELECT DISTINCT id AS chunk_id, md5(content) AS digest, true AS within_limits FROM chunks
            WHERE id IS NOT NULL AND (strlen(content) > 4096 OR len(regexp_extract_all(content, '[^ \t\r\n]+')) > 400)""",
        "p7_mix_bounds": r"""
            WITH t AS (SELECT DISTINCT regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g') AS source FROM mix_targets WHERE source IS NOT NULL),
              d AS (SELECT regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g') AS source, count(DISTINCT doc_id) AS n FROM documents WHERE trim(text) <> '' GROUP BY ALL)
            SELECT source, coalesce(n, 0) AS n_documents, true AS within_cap, true AS near FROM t LEFT JOIN d USING (source)""",
    }
