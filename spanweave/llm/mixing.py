"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the output over its
share of the input, both in characters. A document's count inverts the Poisson
distribution of that mean at a number in [0, 1) hashed from the seed and its
id, so no random state is kept and any executor draws the same count. Copies
are spread by a hash of (seed, id, copy): the hash picks the partition and the
order within it, which shuffles globally without sampling the keys.

Defined cases: a null source is the source ''; a source without a target weight
gets weight 0 when targets are given; a null or empty text counts zero
characters, and a source with zero characters is left out; very long texts are
counted and repeated whole; rows that repeat an id draw the same count and key;
a row with a null id draws by its text; rows that tie in key and copy, as repeated
rows do, lie in any order; an empty table gives an empty table. Input columns named ``copy`` or ``mix_key`` are replaced in
``mixed``; ``replicated`` returns the input's columns only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.storage import Written

SEED = 17


def _draw(*parts) -> F.Column:
    return F.md5(F.concat_ws("|", *parts))


def ident_of(id_col: str, text_col: str) -> F.Column:
    """What a row is hashed by: its id, or its text's hash where it has none, so that such rows don't go together."""
    return F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))))


def source_rates(docs: DataFrame, source_col: str = "source", text_col: str = "text", targets: dict[str, float] | None = None) -> DataFrame:
    """(src, chars, rate) for each source. Without ``targets`` a source's weight is the root of its size."""
    sizes = docs.groupBy(F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("src")).agg(
        F.coalesce(F.sum(F.length(F.col(f"`{text_col}`")).cast("long")), F.lit(0)).cast("long").alias("chars")
    )
    if targets is None:
        w = F.sqrt(F.col("chars").cast("double"))
    else:
        if any(v < 0 for v in targets.values()):
            raise ValueError("target weights must not be negative")
        w = F.lit(0.0)
        for name, v in sorted(targets.items()):
            w = F.when(F.col("src") == name, F.lit(float(v))).otherwise(w)
    all_sources = Window.partitionBy(F.lit(1))  # one row per source
    return (
        sizes.filter("chars > 0")
        .select("src", "chars", w.alias("w"))
        .select("src", "chars", (F.col("w") / F.sum("w").over(all_sources) * F.sum("chars").over(all_sources) / F.col("chars")).alias("rate"))
        .filter("rate > 0")
    )


def _distribution(rates: DataFrame) -> DataFrame:
    """(src, cdf): the distribution function at 0, 1, ... to where its tail is below the draw's grain."""
    top = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int")
    w = Window.partitionBy("src").orderBy("k")
    return (
        rates.select("src", "rate", F.explode(F.sequence(F.lit(0), top)).alias("k"))
        .withColumn("lf", F.sum(F.when(F.col("k") > 0, F.ln(F.col("k").cast("double"))).otherwise(F.lit(0.0))).over(w))
        .withColumn("p", F.exp(-F.col("rate") + F.col("k") * F.ln("rate") - F.col("lf")))
        .withColumn("c", F.sum("p").over(w))
        .groupBy("src")
        .agg(F.sort_array(F.collect_list("c")).alias("cdf"))
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", targets: dict[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """The documents' columns, ``copy`` from 1 on, and ``mix_key``, in globally shuffled order."""
    table = Written(_distribution(source_rates(docs, source_col, text_col, targets)), "rates")
    names = [c for c in docs.columns if c not in ("copy", "mix_key")]
    ident = ident_of(id_col, text_col)
    u = F.conv(F.substring(_draw(F.lit(str(seed)), ident), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
        F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("_src"),
        ident.alias("_id"),
        u.alias("_u"),
    )
    n = F.size(F.filter("cdf", lambda c: c <= F.col("_u")))
    copies = (
        rows.join(table.side(), F.col("_src") == F.col("src"))
        .select("_row", "_id", n.alias("_n"))
        .filter("_n > 0")
        .select("_row", "_id", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"))
    )
    key = F.conv(F.substring(_draw(F.lit(str(seed)), F.col("_id"), F.col("_copy").cast("string")), 1, 15), 16, 10).cast("long")
    keyed = copies.select("_row", F.col("_copy").cast("long").alias("copy"), key.alias("mix_key"))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key", "copy").select(*[F.col(f"_row.`{c}`").alias(c) for c in names], "copy", "mix_key")


def replicated(docs: DataFrame, **kw) -> DataFrame:
    """``mixed`` with the input's columns only. An input column named copy or mix_key is kept."""
    names = docs.columns
    safe = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    place = {c: f"c{names.index(c)}" for c in names}
    cols = {k: place[kw.pop(k, d)] for k, d in (("id_col", "doc_id"), ("source_col", "source"), ("text_col", "text"))}
    return mixed(safe, **cols, **kw).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def sql_mixed(table: str, seed: int = SEED) -> str:
    ident = "coalesce(CAST(doc_id AS VARCHAR), '~' || md5(coalesce(text, '')))"
    return f"""
WITH src AS (SELECT coalesce(source, '') AS src, CAST(sum(length(text)) AS BIGINT) AS chars FROM {table} GROUP BY 1 HAVING sum(length(text)) > 0),
rate AS (SELECT src, sqrt(CAST(chars AS DOUBLE)) / (SELECT sum(sqrt(CAST(chars AS DOUBLE))) FROM src) * (SELECT sum(chars) FROM src) / chars AS rate FROM src),
ks AS (SELECT src, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS k FROM rate),
p AS (SELECT src, k, exp(-rate + k * ln(rate) - sum(CASE WHEN k > 0 THEN ln(CAST(k AS DOUBLE)) ELSE 0 END) OVER (PARTITION BY src ORDER BY k)) AS p FROM ks),
c AS (SELECT src, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS c FROM p),
cdf AS (SELECT src, list(c ORDER BY c) AS cdf FROM c GROUP BY src),
n AS (SELECT d.*, len(list_filter(cdf, lambda x: x <= CAST(('0x' || substr(md5('{seed}|' || {ident}), 1, 13)) AS BIGINT) / 4503599627370496.0)) AS n
  FROM {table} d JOIN cdf ON coalesce(d.source, '') = cdf.src),
e AS (SELECT *, CAST(unnest(range(1, n + 1)) AS BIGINT) AS copy FROM n WHERE n > 0)
SELECT * EXCLUDE (n), CAST(('0x' || substr(md5('{seed}|' || {ident} || '|' || copy), 1, 15)) AS BIGINT) AS mix_key FROM e"""
