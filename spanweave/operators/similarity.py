"""Set, sketch and edit similarities of texts and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def jaccard_join(left: DataFrame, right: DataFrame, floor: float = 0.0, cap: int | None = None) -> DataFrame:
    """(query_id, doc_id, shared, jaccard) of the fingerprint sets of two feature tables (doc_id, fp).

    An inverted join on the fingerprint; pairs that share none are not formed.
    With ``cap``, fingerprints of more documents only count towards set sizes.
    """
    a, b = left.select(F.col("doc_id").alias("query_id"), "fp").distinct(), right.select("doc_id", "fp").distinct()
    na, nb = a.groupBy("query_id").agg(F.count("*").alias("na")), b.groupBy("doc_id").agg(F.count("*").alias("nb"))
    used = b if cap is None else b.join(b.groupBy("fp").count().filter(F.col("count") <= cap), "fp", "left_semi")
    shared = used.join(a, "fp").groupBy("query_id", "doc_id").agg(F.count("*").alias("shared"))
    return shared.join(na, "query_id").join(nb, "doc_id").select("query_id", "doc_id", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard")).filter(F.col("jaccard") >= floor)


def simhash(features: DataFrame, bits: int = 32) -> DataFrame:
    """(doc_id, simhash) by Charikar's sign sums over distinct fingerprints (hex strings); a sum of zero sets the bit."""
    if not 1 <= bits <= 32:
        raise ValueError("bits must be 1 to 32")
    h = features.select("doc_id", "fp").distinct().select("doc_id", F.conv(F.substring("fp", 1, 8), 16, 10).cast("long").alias("h"))
    sums = [F.sum(F.shiftright("h", i).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"b{i}") for i in range(bits)]
    s = h.groupBy("doc_id").agg(*sums)
    total = sum((F.when(F.col(f"b{i}") >= 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(bits)), F.lit(0).cast("long"))
    return s.select("doc_id", total.alias("simhash"))


def hamming(a, b):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def edit_similarity(a, b):
    """1 less the Levenshtein distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(F.col(a), F.col(b)) / longest)


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, vec_id, cosine, rank): exact nearest vectors by cosine, the query itself left out.

    Every pair is scored inside the JVM, and each partition keeps its own k best
    before the shuffle. Vectors of zero length are left out.
    """
    def unit(df: DataFrame, name: str, v: str) -> DataFrame:
        x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
        norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, e: a + e * e))
        return df.select(F.col(id_col).alias(name), x.alias(v), norm.alias(f"{v}n")).filter(F.col(f"{v}n") > 0)

    dot = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0), lambda a, e: a + e)
    pairs = unit(vectors, "vec_id", "v").crossJoin(unit(queries, "query_id", "q")).filter("query_id <> vec_id")
    scored = pairs.select("query_id", "vec_id", F.round(dot / (F.col("qn") * F.col("vn")), 6).alias("cosine"))
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), F.asc("vec_id"))
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def equal_positions(a: str, b: str):
    """Characters that agree place by place, over the shorter length."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(0)).otherwise(F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(F.col(a), i, F.lit(1)) == F.substring(F.col(b), i, F.lit(1))))).cast("long")
