"""Evaluation of scored, labelled rows: (query_id, doc_id, score, label 0/1).

Rows of one score are one step: none of them can be accepted without the
others, so no measure depends on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _steps(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "score").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("pos"))


def pr_curve(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by + (score, tp, accepted, total, precision, recall, f1) at each distinct score; groups without positives are left out.

    Distinct scores are few against rows, and the running sums are over them only.
    """
    by = by or []
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    run = w.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    c = _steps(rows, by).select(*by, "score", F.sum("pos").over(run).alias("tp"), F.sum("n").over(run).alias("accepted"), F.sum("pos").over(w).alias("total")).filter("total > 0")
    return c.withColumns({"precision": F.col("tp") / F.col("accepted"), "recall": F.col("tp") / F.col("total"), "f1": 2 * F.col("tp") / (F.col("accepted") + F.col("total"))})


def average_precision(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by + (ap): the sum over steps of recall gained times precision."""
    by = by or []
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy(F.desc("score"))
    c = pr_curve(rows, by).withColumn("gain", F.col("recall") - F.coalesce(F.lag("recall").over(w), F.lit(0.0)))
    out = c.groupBy(*by) if by else c
    return out.agg(F.round(F.sum(F.col("gain") * F.col("precision")), 9).alias("ap"))


def mean_average_precision(rows: DataFrame) -> DataFrame:
    """One row: mean of each query's average precision, over queries with a positive."""
    return average_precision(rows, ["query_id"]).agg(F.round(F.avg("ap"), 6).alias("map"), F.count("*").alias("queries"))


def expected_reciprocal_rank(rows: DataFrame) -> DataFrame:
    """(query_id, mrr): reciprocal rank of the first positive, averaged over the orders of its ties.

    With ``a`` rows ahead and a tie of n rows with m positives, the first
    positive is j-th of the tie with chance C(n - j, m - 1) / C(n, m).
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"))
    s = _steps(rows, ["query_id"]).withColumn("ahead", F.sum("n").over(w) - F.col("n")).filter("pos > 0")
    first = s.groupBy("query_id").agg(F.min_by(F.struct("ahead", "n", "pos"), "ahead").alias("t"))
    # chance that the first j - 1 of the tie hold no positive, times the chance of one at j
    acc = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.col("t.n") - F.col("t.pos") + 1),
        F.struct(F.lit(1.0).alias("none"), F.lit(0.0).alias("sum")),
        lambda a, j: F.struct(
            (a["none"] * (F.col("t.n") - F.col("t.pos") - j + 1) / F.greatest(F.col("t.n") - j + 1, F.lit(1))).alias("none"),
            (a["sum"] + a["none"] * F.col("t.pos") / (F.col("t.n") - j + 1) / (F.col("t.ahead") + j)).alias("sum"),
        ),
        lambda a: a["sum"],
    )
    return first.select("query_id", F.round(acc, 9).alias("mrr"))


def expected_recall_at(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): positives expected among the first k over all positives; the tie at k counts in proportion."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"))
    s = _steps(rows, ["query_id"]).withColumn("ahead", F.sum("n").over(w) - F.col("n"))
    inside = F.least(F.greatest(F.lit(k) - F.col("ahead"), F.lit(0)), F.col("n"))
    r = s.groupBy("query_id").agg(F.sum(F.col("pos") * inside / F.col("n")).alias("got"), F.sum("pos").alias("total")).filter("total > 0")
    return r.select("query_id", F.round(F.col("got") / F.col("total"), 9).alias("recall"))


def ndcg_at(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, ndcg): gain label, discount 1 / log2(rank + 1); ties by document id (Järvelin and Kekäläinen 2002)."""
    w = Window.partitionBy("query_id")
    r = rows.withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), F.asc("doc_id")))).withColumn("i", F.row_number().over(w.orderBy(F.desc("label"), F.asc("doc_id"))))
    gain = lambda rank: F.sum(F.when(F.col(rank) <= k, F.col("label") / F.log2(F.col(rank) + F.lit(1.0))).otherwise(F.lit(0.0)))
    return r.groupBy("query_id").agg(gain("r").alias("d"), gain("i").alias("best")).filter("best > 0").select("query_id", F.round(F.col("d") / F.col("best"), 9).alias("ndcg"))


def proper_scores(rows: DataFrame, clamp: float = 1e-15) -> DataFrame:
    """One row: Brier score and log-loss of scores as probabilities."""
    p = F.least(F.greatest(F.col("score"), F.lit(clamp)), F.lit(1 - clamp))
    y = F.col("label")
    return rows.agg(F.round(F.avg((F.col("score") - y) * (F.col("score") - y)), 9).alias("brier"), F.round(F.avg(-F.when(y == 1, F.log(p)).otherwise(F.log(1 - p))), 9).alias("log_loss"))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """One row: expected and maximum gap of confidence and accuracy over bins of equal width."""
    if bins < 1:
        raise ValueError("needs a bin")
    b = rows.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("score") - F.avg("label")).alias("gap"))
    return b.agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 9).alias("ece"), F.round(F.max("gap"), 9).alias("mce"))


def operating_point(rows: DataFrame, least_precision: float) -> DataFrame:
    """One row: of the thresholds of at least that precision the one of most recall, then precision, then score."""
    c = pr_curve(rows).filter(F.col("precision") >= least_precision)
    best = c.agg(F.max(F.struct("recall", "precision", "score", "tp", "accepted")).alias("b")).filter("b IS NOT NULL")
    return best.select(F.col("b.score").alias("threshold"), F.round("b.precision", 9).alias("precision"), F.round("b.recall", 9).alias("recall"), "b.tp", "b.accepted")


def slices(rows: DataFrame, facets: list[str], threshold: float) -> DataFrame:
    """facets + (n, positives, accepted, hits) for every combination of facets; null stands for all values."""
    s = rows.select(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in facets], "score", "label")
    acc = (F.col("score") >= threshold).cast("long")
    return s.cube(*facets).agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("positives"), F.sum(acc).alias("accepted"), F.sum(acc * F.col("label")).cast("long").alias("hits"))


def bootstrap_interval(per_query: DataFrame, value: str, replicates: int = 1000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """One row: mean and percentile interval of a per-query value under resampling of queries.

    A replicate draws each query a Poisson(1) number of times from a hash of
    (seed, replicate, query), which needs no join and no random state.
    """
    if replicates < 1 or not 0 < level < 1:
        raise ValueError("needs a replicate, and a level between 0 and 1")
    u = F.pmod(F.xxhash64(F.lit(seed), "b", "query_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    cdf, p = [], 2.718281828459045**-1
    total = 0.0
    for k in range(12):
        total += p
        cdf.append(total)
        p /= k + 1
    n = sum(((u >= c).cast("long") for c in cdf), F.lit(0).cast("long"))
    rep = per_query.select("query_id", F.col(value).alias("v"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("b")).select("b", "v", n.alias("n"))
    means = rep.groupBy("b").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("m"))
    a = (1 - level) / 2
    return means.crossJoin(per_query.agg(F.avg(value).alias("mean"))).groupBy("mean").agg(F.percentile("m", F.lit(a)).alias("low"), F.percentile("m", F.lit(1 - a)).alias("high"))


def hard_negatives(rows: DataFrame, per_query: int) -> DataFrame:
    """(query_id, doc_id, score, label, rank): all positives, and each query's best-scored negatives."""
    w = Window.partitionBy("query_id", "label").orderBy(F.desc("score"), F.asc("doc_id"))
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).filter((F.col("label") == 1) | (F.col("rank") <= per_query)).select("query_id", "doc_id", "score", "label", "rank")


def plagdet(cases: DataFrame, found: DataFrame) -> DataFrame:
    """One row of macro precision, recall, granularity and plagdet (Potthast et al. 2010).

    Both tables: (id, doc, start, end, src, src_start, src_end), half open. A
    detection belongs to a case when both stretches overlap. Overlap of
    detections counts once on the document side.
    """
    from spanweave.operators.intervals import covered

    a, b = cases.alias("a"), found.alias("b")
    on = (F.col("a.doc") == F.col("b.doc")) & (F.col("a.src") == F.col("b.src")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")) & (F.col("a.src_start") < F.col("b.src_end")) & (F.col("b.src_start") < F.col("a.src_end"))
    j = a.join(b, on).select(F.col("a.id").alias("case_id"), F.col("b.id").alias("found_id"), F.greatest("a.start", "b.start").alias("start"), F.least("a.end", "b.end").alias("end"))

    def mean_share(key: str, whole: DataFrame, name: str) -> DataFrame:
        got = covered(j, [key]).withColumnRenamed(key, "id")
        return whole.join(got, "id", "left").agg(F.avg(F.coalesce("covered", F.lit(0)) / (F.col("end") - F.col("start"))).alias(name))

    g = j.groupBy("case_id").agg(F.countDistinct("found_id").alias("n")).agg(F.coalesce(F.avg("n"), F.lit(1.0)).alias("granularity"))
    r = mean_share("found_id", found, "precision").crossJoin(mean_share("case_id", cases, "recall")).crossJoin(g)
    p, q = F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0))
    f1 = F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(F.lit(0.0))
    return r.select(F.round(p, 9).alias("precision"), F.round(q, 9).alias("recall"), F.round("granularity", 9).alias("granularity"), F.round(f1 / F.log2(1 + F.col("granularity")), 9).alias("plagdet"))
