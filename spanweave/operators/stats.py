"""Robust statistics, entropy, percentiles by rank, seeded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def mad_outliers(rows: DataFrame, key: str, ident: str, value: str, times: float = 3.0) -> DataFrame:
    """(ident, key, value, median, mad) for values further than ``times`` median absolute deviations from their group's median."""
    v = rows.select(F.col(ident), F.col(key), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    med = v.groupBy(key).agg(F.median("v").alias("median"))
    dev = v.join(med, key).withColumn("d", F.abs(F.col("v") - F.col("median")))
    mad = dev.groupBy(key).agg(F.median("d").alias("mad"))
    return dev.join(mad, key).filter((F.col("mad") > 0) & (F.col("d") > times * F.col("mad"))).select(ident, key, F.round("v", 6).alias(value), F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


def token_entropy(terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """key + (n, distinct, entropy): Shannon entropy in bits of each group's words (column term)."""
    c = terms.groupBy(key, "term").agg(F.count("*").alias("c"))
    s = c.groupBy(key).agg(F.sum("c").alias("n"), F.count("*").alias("distinct"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return s.select(key, "n", "distinct", F.round(F.log2("n") - F.col("s") / F.col("n"), 6).alias("entropy"))


def rank_percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """key + one column per share: the value of rank floor((n - 1) * share + 1/2) of n, never interpolated."""
    w = Window.partitionBy(key)
    r = rows.filter(F.col(value).isNotNull()).select(key, F.col(value).alias("v"), (F.row_number().over(w.orderBy(value)) - 1).alias("r"), F.count("*").over(w).alias("n"))
    pick = [F.max(F.when(F.col("r") == F.floor((F.col("n") - 1) * s + 0.5), F.col("v"))).alias(name) for name, s in shares.items()]
    return r.groupBy(key).agg(*pick)


def seeded_sample(rows: DataFrame, ident: str, n: int, seed: int) -> DataFrame:
    """(ident, key): the n rows of least md5(seed:id), the same on every run and layout."""
    k = F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")))
    return rows.select(F.col(ident), k.alias("key")).orderBy("key", ident).limit(n)


def prevalence(rows: DataFrame, unit: str, kind: str) -> DataFrame:
    """(kind, units, share): in how many units a kind occurs, and their share of all units."""
    total = rows.agg(F.countDistinct(unit).alias("total"))
    return rows.groupBy(kind).agg(F.countDistinct(unit).alias("units")).crossJoin(total).select(kind, "units", F.round(F.col("units") / F.col("total"), 9).alias("share"))


def best_by(rows: DataFrame, key: str, value: str, ident: str) -> DataFrame:
    """key + (ident, value): each group's row of greatest value, ties to the smaller id."""
    return rows.groupBy(key).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(ident)).alias("i"))).alias("m")).select(key, (-F.col("m.i")).alias(ident), F.col("m.v").alias(value))
