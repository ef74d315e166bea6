"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanweave.llm import chat_pairs, decontamination, language_id, line_dedup, minhash_dedup, mixing, quality_mil, quality_rules, recompression, resharding


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict:
    return {
        "op1_language_id": lambda s, d: language_id.identify(_table(s, d, "documents")),
        "op2_benchmark_matches": lambda s, d: decontamination.matches(_table(s, d, "documents"), _table(s, d, "benchmark")),
        "op3_poisson_mixing": lambda s, d: mixing.mixed(_table(s, d, "documents")),
        "op4_quality_mil": lambda s, d: quality_mil.classify(_table(s, d, "documents"), _table(s, d, "labels")),
        "op5_line_dedup": lambda s, d: line_dedup.line_dedup(_table(s, d, "documents")),
        "op6_recompression_repeats": lambda s, d: recompression.repeats(_table(s, d, "documents")),
        "op7_flow_resharding": lambda s, d: resharding.reshard(_table(s, d, "documents")),
        "op8_quality_rules": lambda s, d: quality_rules.measure(_table(s, d, "documents")),
        "op10_minhash_groups": lambda s, d: minhash_dedup.near_links(_table(s, d, "documents")),
        "op9_preference_pairs": lambda s, d: chat_pairs.format_conversations(_table(s, d, "conversations")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_benchmark_matches": decontamination.sql_matches("documents", "benchmark"),
        "op3_poisson_mixing": mixing.sql_mixed("documents"),
        "op5_line_dedup": line_dedup.ORACLE,
        "op6_recompression_repeats": recompression.sql_repeats("documents"),
        "op7_flow_resharding": resharding.sql_reshard("documents"),
        "op8_quality_rules": quality_rules.oracle(),
        "op9_preference_pairs": chat_pairs.ORACLE,
        "op10_minhash_groups": minhash_dedup.sql_links("documents"),
    }
