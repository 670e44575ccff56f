"""The queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evenkeel.llm import centroids, columnar, conversations, language, lattice, mixing, neighbours, pieces, quality, rules, sharding, simhash, sql, tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": rules.op1,
        "op2_sentencepiece": pieces.op2,
        "op3_quality_classifier": quality.op3,
        "op4_lattice_lm": lattice.op4,
        "op5_language_id": language.op5,
        "op6_token_counts": tokens.op6,
        "op7_mix_sources": mixing.op7,
        "op8_nearest_neighbours": neighbours.op8,
        "op9_simhash": simhash.op9,
        "op10_shards": sharding.op10,
        "op11_conversation_repair": conversations.op11,
        "op12_exact_top_k": columnar.op12,
        "op13_centroids": centroids.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": sql.quality_rules(), "op7_mix_sources": sql.mix_sources(), "op11_conversation_repair": sql.conversation_repair(), "op12_exact_top_k": sql.exact_top_k(), "op13_centroids": sql.centroids()}
