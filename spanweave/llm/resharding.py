"""Minimum-cost-flow resharding.

Old shards hold blocks of documents; new shards have capacities. A byte that
stays in the shard of the same number costs nothing, a byte that moves costs
one. The flow runs from the old shards to the new ones, straight or through one
node for the network between them, so its size is the number of shards, never of
rows. Its shortest augmenting paths are first those of cost 0, which share no
arc but with themselves, then those of cost 1 through the network; once the
first are saturated none becomes free again, so two passes over the shards give
a flow of least cost in linear time.

Blocks then follow the flow: within a shard, in order of block, the first bytes
stay and the rest goes to the receiving shards in order. Whole blocks move, so
a shard can exceed its capacity by less than one block for each shard it
receives from or keeps from. What rows look up is the last block of each
transfer, as many entries as there are transfers. Shards that gain or lose rows
are written anew to the shared folder, one folder each; only rows that move are
shuffled.

Defined cases: a null shard name is the shard ''; null texts weigh nothing;
a row with a null id goes by its text's hash; rows that tie in their block, repeated rows among
them, go together; a very long text is moved whole, with its block; a shard that
loses all its rows has no folder and is named as emptied; an empty table gives
an empty table; input columns named old_shard, new_shard or moved are replaced.
Capacities that don't hold the total are refused.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spanweave.llm.mixing import ident_of
from spanweave.storage import Written, folder

#: Blocks of each old shard. One block is what moves as a whole.
BLOCKS = 4096
#: New shards and the room they have above an even share, in percent.
NEW_SHARDS = 24
SLACK = 2


def transfers(sizes: list[int], capacities: list[int]) -> list[tuple[int, int, int]]:
    """(old, new, bytes) that move the fewest bytes; old i and new i are the same shard."""
    if sum(sizes) > sum(capacities):
        raise ValueError(f"capacities hold {sum(capacities)} bytes of {sum(sizes)}")
    n, m = len(sizes), len(capacities)
    stay = [min(sizes[i], capacities[i]) for i in range(min(n, m))] + [0] * max(0, n - m)
    plan = [(i, i, x) for i, x in enumerate(stay) if x]
    takes = ((j, c - (stay[j] if j < n else 0)) for j, c in enumerate(capacities))
    j = room = 0
    for i in range(n):
        left = sizes[i] - stay[i]
        while left:
            while not room:
                j, room = next(takes)
            x = min(left, room)
            plan.append((i, j, x))
            left, room = left - x, room - x
    return plan


def _hashed(id_col: str, shard_col: str, text_col: str):
    block = F.pmod(F.conv(F.substring(F.md5(ident_of(id_col, text_col)), 1, 8), 16, 10).cast("long"), F.lit(BLOCKS))
    return F.coalesce(F.col(f"`{shard_col}`").cast("string"), F.lit("")), block


def block_plan(docs: DataFrame, capacities: list[int] | None = None, id_col: str = "doc_id", shard_col: str = "source", text_col: str = "text") -> DataFrame:
    """(shard, old_shard, new_shard, upto): the blocks of a shard up to upto, from where the entry before ends, go to new_shard."""
    spark = docs.sparkSession
    shard, block = _hashed(id_col, shard_col, text_col)
    weight = F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("long")
    blocks = Written(docs.groupBy(shard.alias("shard"), block.alias("block")).agg(F.sum(weight).alias("nbytes")), "blocks").df
    shards = sorted((r.shard, r.n) for r in blocks.groupBy("shard").agg(F.sum("nbytes").alias("n")).collect())  # one row per shard
    sizes = [n for _, n in shards]
    if capacities is None:
        capacities = [-(-sum(sizes) * (100 + SLACK) // (100 * NEW_SHARDS))] * NEW_SHARDS
    rows, upto = [], {}
    plan = transfers(sizes, capacities)
    for i, j, x in sorted(plan, key=lambda p: (p[0], p[0] != p[1], p[1])):  # what stays comes first
        rows.append((shards[i][0], i, j, upto.get(i, 0), upto.get(i, 0) + x))
        upto[i] = upto.get(i, 0) + x
    last = {r[0]: k for k, r in enumerate(rows)}
    rows = [r if last[r[0]] != k else (*r[:4], 1 << 62) for k, r in enumerate(rows)]  # the last part takes blocks of no bytes too
    rows += [(name, i, i if i < len(capacities) else 0, 0, 1 << 62) for i, (name, n) in enumerate(shards) if not n]
    parts = spark.createDataFrame(rows, "part_shard string, old_shard long, new_shard long, lo long, hi long")
    before = F.coalesce(F.sum("nbytes").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # BLOCKS rows a shard
    placed = blocks.withColumn("at", before)
    small = F.broadcast(parts) if len(rows) <= 100_000 else parts
    on = (F.col("shard") == F.col("part_shard")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))
    return placed.join(small, on).groupBy("shard", "old_shard", "new_shard").agg(F.max("block").alias("upto"))


class Placement:
    """Where each row goes: ``rows`` has the documents' columns, old_shard, new_shard and moved."""

    def __init__(self, docs: DataFrame, capacities: list[int] | None = None, id_col: str = "doc_id", shard_col: str = "source", text_col: str = "text"):
        self.plan = Written(block_plan(docs, capacities, id_col, shard_col, text_col), "plan")
        way = self.plan.df.groupBy("shard", "old_shard").agg(F.sort_array(F.collect_list(F.struct("upto", "new_shard"))).alias("way"))
        way = Written(way, "way").side()
        names = [c for c in docs.columns if c not in ("old_shard", "new_shard", "moved")]
        shard, block = _hashed(id_col, shard_col, text_col)
        own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), shard.alias("_shard"), block.alias("_block"))
        to = F.element_at(F.filter("way", lambda w: w["upto"] >= F.col("_block")), 1)["new_shard"]
        placed = own.join(way, F.col("_shard") == F.col("shard")).select("_row", "_block", "old_shard", to.alias("new_shard")).withColumn("moved", F.col("old_shard") != F.col("new_shard"))
        going = placed.filter("moved").repartition("new_shard", F.pmod("_block", F.lit(16)))
        self.staying, moving = (x.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], "old_shard", "new_shard", "moved") for x in (placed.filter("NOT moved"), going))
        self.rows = self.staying.unionByName(moving)

    def affected(self) -> tuple[list[int], list[int]]:
        """(shards that gain or lose rows, those of them that lose all and gain none). One entry for each transfer is read."""
        pairs = [(r.old_shard, r.new_shard) for r in self.plan.df.select("old_shard", "new_shard").distinct().collect()]
        hit = {s for p in pairs if p[0] != p[1] for s in p}
        return sorted(hit), sorted(hit - {j for _, j in pairs})


class Rewritten(NamedTuple):
    """Numbers of the shards written, of those left without rows (their old files are to go), and the folder."""

    written: list[int]
    emptied: list[int]
    path: str


def rewrite_affected(placement: Placement, out: str | None = None) -> Rewritten:
    """Writes each shard that gains or loses rows to ``out/new_shard=N``; other shards keep their files."""
    spark = placement.rows.sparkSession
    hit, emptied = placement.affected()
    out = out or folder(spark, "shards")
    written = [s for s in hit if s not in set(emptied)]
    placement.rows.join(_numbers(spark, written), "new_shard", "left_semi").write.option("compression", "zstd").partitionBy("new_shard").parquet(out)
    return Rewritten(written, emptied, out)


def _numbers(spark: SparkSession, shards: list[int]) -> DataFrame:
    table = spark.createDataFrame([(s,) for s in shards], "new_shard long")
    return F.broadcast(table) if len(shards) <= 1_000_000 else table


def reshard(docs: DataFrame, capacities: list[int] | None = None, id_col: str = "doc_id", shard_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents' columns, old_shard, new_shard and moved: affected shards as written and read again, the others as they are."""
    placement = Placement(docs, capacities, id_col, shard_col, text_col)
    spark, rows = docs.sparkSession, placement.rows
    done = rewrite_affected(placement)
    if not done.written:
        return rows
    kept = [f for f in rows.schema.fields if f.name != "new_shard"]
    again = spark.read.schema(T.StructType([*kept, T.StructField("new_shard", T.LongType())])).parquet(done.path).select(rows.columns)
    same = placement.staying.join(_numbers(spark, done.written), "new_shard", "left_anti").select(rows.columns)
    return same.unionByName(again)


def sql_reshard(table: str) -> str:
    return f"""
WITH d AS (SELECT *, coalesce(source, '') AS shard, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '~' || md5(coalesce(text, '')))), 1, 8)) AS BIGINT) % {BLOCKS} AS block, CAST(strlen(coalesce(text, '')) AS BIGINT) AS nb FROM {table}),
b AS (SELECT shard, block, CAST(sum(nb) AS BIGINT) AS nb FROM d GROUP BY ALL),
s AS (SELECT shard, CAST(sum(nb) AS BIGINT) AS size, row_number() OVER (ORDER BY shard) - 1 AS i FROM b GROUP BY shard),
cap AS (SELECT CAST(ceil(sum(size) * {100 + SLACK} / (100.0 * {NEW_SHARDS})) AS BIGINT) AS cap FROM s),
o AS (SELECT shard, i, size, CASE WHEN i < {NEW_SHARDS} THEN least(size, cap) ELSE 0 END AS keep FROM s, cap),
g AS (SELECT *, coalesce(sum(size - keep) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g0 FROM o),
n AS (SELECT j, cap - coalesce((SELECT keep FROM o WHERE o.i = j), 0) AS room FROM (SELECT unnest(range(0, {NEW_SHARDS})) AS j), cap),
r AS (SELECT j, sum(room) OVER (ORDER BY j) - room AS r0, sum(room) OVER (ORDER BY j) AS r1 FROM n WHERE room > 0),
p AS (SELECT b.shard, b.block, g.i, g.keep, g.g0, g.size, coalesce(sum(b.nb) OVER (PARTITION BY b.shard ORDER BY b.block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM b JOIN g ON b.shard = g.shard),
q AS (SELECT p.shard, p.block, p.i AS old_shard, CASE WHEN p.at < p.keep OR p.size = p.keep THEN p.i ELSE r.j END AS new_shard
  FROM p LEFT JOIN r ON p.at >= p.keep AND p.size > p.keep AND p.g0 + least(p.at, p.size - 1) - p.keep >= r.r0 AND p.g0 + least(p.at, p.size - 1) - p.keep < r.r1)
SELECT d.* EXCLUDE (shard, block, nb), CAST(q.old_shard AS BIGINT) AS old_shard, CAST(q.new_shard AS BIGINT) AS new_shard, q.old_shard <> q.new_shard AS moved
FROM d JOIN q ON d.shard = q.shard AND d.block = q.block"""
