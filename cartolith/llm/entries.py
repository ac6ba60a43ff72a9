"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartolith.llm import bpe, linededup, lm, neardup, packing, quality_cnn, quality_rules, topk, toxicity, warc
from cartolith.llm.common import table


def vocabulary() -> str:
    """The tokenizer file: CARTOLITH_VOCABULARY, else the installed public one."""
    if path := os.environ.get("CARTOLITH_VOCABULARY"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), vocabulary())


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digest(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_bpe": op2_bpe,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_warc": op4_warc,
        "op5_quality_rules": op5_quality_rules,
        "op6_lm": op6_lm,
        "op7_line_dedup": op7_line_dedup,
        "op8_packing": op8_packing,
        "op9_topk": op9_topk,
        "op10_quality_classifier": op10_quality_classifier,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": warc.ORACLE, "op7_line_dedup": linededup.ORACLE, "op9_topk": topk.ORACLE}
