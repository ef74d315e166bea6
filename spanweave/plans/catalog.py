"""The library's own registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NORM = r"trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' '))"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.expr(NORM).alias("norm"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_text(spark, sf_dir)


def queries() -> dict:
    return {"norm_text": norm_text}


def oracle_sql() -> dict[str, str]:
    return {"norm_text": "SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS norm FROM documents"}
