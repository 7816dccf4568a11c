"""Shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_name(col):
    """Names spelled with blanks, capitals or hyphens become one spelling."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[\s-]+", "_")
