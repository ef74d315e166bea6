"""Combining ranked lists and independent evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(scored: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, rank) with ranks from 1, ties to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(w).cast("long"))


def rrf(lanes: list[DataFrame], k: int = 60) -> DataFrame:
    """(query_id, doc_id, lanes, rrf): reciprocal rank fusion, the sum of 1 / (k + rank) (Cormack et al. 2009)."""
    if not lanes or k < 0:
        raise ValueError("needs a lane, and k of at least 0")
    rows = reduce(DataFrame.unionByName, [ranked(x).select("query_id", "doc_id", "rank") for x in lanes])
    return rows.groupBy("query_id", "doc_id").agg(F.count("*").alias("lanes"), F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 9).alias("rrf"))


def outer_lanes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(query_id, doc_id, left_score, right_score): full outer join of two scored lists."""
    a = left.select("query_id", "doc_id", F.col("score").alias("left_score"))
    b = right.select("query_id", "doc_id", F.col("score").alias("right_score"))
    return a.join(b, ["query_id", "doc_id"], "full_outer")


def noisy_or(evidence: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """keys + (n, combined): one less the product of one less each probability, clamped to [0, 1]; nulls are left out."""
    q = 1 - F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0))
    whole = F.max(F.when(q == 0, F.lit(1)).otherwise(F.lit(0))) == 1
    logs = F.sum(F.when(q > 0, F.log(q)).otherwise(F.lit(0.0)))
    return evidence.filter(F.col(p).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.when(whole, F.lit(1.0)).otherwise(1 - F.exp(logs)), 9).alias("combined"))


def weighted_grid(rows: DataFrame, weights: list[float], label: str = "label") -> DataFrame:
    """(w, hits, queries): for each weight of the left lane, in how many queries the best fused row is relevant.

    rows: (query_id, doc_id, left_score, right_score, label). One job scores all weights.
    """
    grid = rows.sparkSession.createDataFrame([(float(w),) for w in weights], "w double")
    s = F.col("w") * F.coalesce("left_score", F.lit(0.0)) + (1 - F.col("w")) * F.coalesce("right_score", F.lit(0.0))
    best = rows.crossJoin(F.broadcast(grid)).groupBy("w", "query_id").agg(F.max_by(label, F.struct(F.round(s, 9), -F.col("doc_id"))).alias("y"))
    return best.groupBy("w").agg(F.sum(F.col("y").cast("long")).alias("hits"), F.count("*").alias("queries"))
