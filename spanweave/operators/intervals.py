"""Half-open intervals: unions, overlaps, joins on overlap, nearest earlier rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys + (start, end): the union of each group's intervals as disjoint ones. Empty intervals are dropped."""
    by = Window.partitionBy(*keys).orderBy(start, end)
    r = rows.filter(F.col(start) < F.col(end)).select(*keys, F.col(start).alias("s"), F.col(end).alias("e"))
    by = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = r.withColumn("opens", F.when(reach.isNull() | (F.col("s") > reach), F.lit(1)).otherwise(F.lit(0)))
    g = opened.withColumn("g", F.sum("opens").over(by))
    return g.groupBy(*keys, "g").agg(F.min("s").alias("start"), F.max("e").alias("end")).drop("g")


def covered(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys + (covered): length of the union of each group's intervals."""
    return islands(rows, keys, start, end).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("covered"))


def iou(a0, a1, b0, b1):
    """Intersection over union of two intervals; 0 where both are empty."""
    inter = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))
    union = (a1 - a0) + (b1 - b0) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of rows of equal keys whose intervals (start, end) overlap; right columns get the prefix r_.

    Intervals are posted to every cell of ``width`` they touch, so the join is
    an equi-join on (keys, cell); a pair is reported in the cell where the later
    of both begins, hence once. Work is balanced by cell, not by key.
    """
    if width < 1:
        raise ValueError("width must be at least 1")

    def cells(df: DataFrame) -> DataFrame:
        return df.filter("start < end").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))

    r = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    r = r.withColumns({"start": F.col("r_start"), "end": F.col("r_end")})
    rc = cells(r).drop("start", "end")
    j = cells(left).join(rc, [*keys, "_cell"])
    once = F.col("_cell") == F.floor(F.greatest("start", "r_start") / width)
    return j.filter((F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")) & once).drop("_cell")


def latest_before(rows: DataFrame, keys: list[str], order: list[str], ident: str) -> DataFrame:
    """keys + (id, prev_id): the row just before each row of its group; null for the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.select(*keys, F.col(ident).alias("id"), F.lag(ident).over(w).alias("prev_id"))


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str, ident: str) -> DataFrame:
    """(ident, key, at, value): each left row with the value of the last right row of its key at or before it.

    Both sides are unioned and carried forward with one window, so there is one
    shuffle on the key and no range condition.
    """
    a = left.select(F.col(ident).alias("i"), F.col(key).alias("k"), F.col(at).alias("t"), F.lit(None).cast(right.schema[value].dataType).alias("v"), F.lit(1).alias("side"))
    b = right.select(F.lit(None).cast(left.schema[ident].dataType).alias("i"), F.col(key).alias("k"), F.col(at).alias("t"), F.col(value).alias("v"), F.lit(0).alias("side"))
    w = Window.partitionBy("k").orderBy("t", "side", F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    carried = a.unionByName(b).withColumn("v", F.last("v", ignorenulls=True).over(w))
    return carried.filter("side = 1").select(F.col("i").alias(ident), F.col("k").alias(key), F.col("t").alias(at), F.col("v").alias(value))


def latest_peers(rows: DataFrame, group: str, owner: str, at: str, ident: str, limit: int) -> DataFrame:
    """(id, peer_id, rank): for each row the latest earlier rows of its group by other owners."""
    a = rows.select(F.col(ident).alias("id"), F.col(group).alias("g"), F.col(owner).alias("o"), F.col(at).alias("t"))
    b = a.select(F.col("id").alias("peer_id"), "g", F.col("o").alias("po"), F.col("t").alias("pt"))
    w = Window.partitionBy("id").orderBy(F.desc("pt"), F.asc("peer_id"))
    j = a.join(b, "g").filter((F.col("po") != F.col("o")) & (F.col("pt") < F.col("t")))
    return j.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit).select("id", "peer_id", "rank")
