"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's documents. All but the last return the columns
of documents; extra columns, whatever their names, pass through (but for those
that sharding adds: old_shard, new_shard, moved).

Defined cases: a null or empty text has no words and goes in the first stage;
texts of any length are judged whole by every stage; documents are told apart
by id and text, so a copy or a benchmark passage goes also where its id is null
or another text's; of rows that repeat both, one stays before mixing repeats
what it repeats; of a group the smallest id stays, and a null one only where
the group has no other; a null source is the source ''; empty tables pass
through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanweave.llm import decontamination, minhash_dedup, mixing, quality_rules, resharding
from spanweave.storage import Written, made, release


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.accepted(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.replicated(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resharding.reshard(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The stages one after another, for documents with distinct ids.
ORACLE_SQL = f"""
WITH ruled AS MATERIALIZED (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM (SELECT *, {quality_rules.sql_failed()} AS failed FROM ({quality_rules.sql_measures("documents")})) WHERE failed = '')),
near AS MATERIALIZED ({minhash_dedup.sql_links("ruled")}),
single AS MATERIALIZED (SELECT * FROM ruled WHERE doc_id IN (SELECT doc_id FROM near WHERE doc_id = group_id)),
leaks AS MATERIALIZED ({decontamination.sql_matches("single", "benchmark")}),
clean AS MATERIALIZED (SELECT * FROM single WHERE doc_id NOT IN (SELECT doc_id FROM leaks)),
mixed AS MATERIALIZED (SELECT * EXCLUDE (copy, mix_key) FROM ({mixing.sql_mixed("clean")}))
SELECT * FROM ({resharding.sql_reshard("mixed")})
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        mark = made()
        kept = Written(stage(spark, docs, sf_dir), name)
        release(spark, mark, (kept.path,))  # what the stage wrote on its way
        if last:
            last.drop()
        docs, last = kept.df, kept
    return STAGES[-1][1](spark, docs, sf_dir)
