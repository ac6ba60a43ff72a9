"""Corpus preparation in five stages; each takes (spark, docs, sf_dir) and all but the last give the columns of docs.

Defined cases: a stage keeps rows whose doc_id is null if their text passes (near-dedup links them with nothing);
rows that repeat a doc_id share its decisions, which are taken on each row's own text where the stage looks at
single texts; of rows that repeat both doc_id and text one goes on from near-dedup; documents that line dedup leaves
without a word go, as all they said stands in another one; extra columns go through all filtering stages unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm import linededup, neardup, packing, quality_cnn, quality_rules
from cartolith.llm.common import BROADCAST_BYTES, has_at_most, released, table, written
from cartolith.llm.entries import vocabulary


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the quality classifier rejects go."""
    return quality_cnn.kept(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the quality rules reject go."""
    return quality_rules.kept(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: repeated lines go, but from the document of largest id; and what has no word left."""
    return linededup.deduplicated(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near-duplicates, at a similarity of 0.8, the document of smallest id stays."""
    found = written(neardup.near_duplicates(docs, percent=80), "pipeline-groups")
    drop = written(found.where(~F.col("kept")).select(F.col("doc_id").alias("__drop")).distinct(), "pipeline-drop")
    if has_at_most(drop, BROADCAST_BYTES // 32):  # then no text is shuffled
        drop = F.broadcast(drop)
    kept = docs.join(drop, docs["doc_id"].cast("long") == drop["__drop"], "left_anti")
    again = written(found.where("doc_id is not null").groupBy(F.col("doc_id").alias("__again")).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n"), "pipeline-again")
    if again.isEmpty():
        return kept
    same = kept["doc_id"].cast("long") == again["__again"]
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("line dedup", lines),
    ("MinHash near-dedup", near),
    ("packing", pack),
]

#: The classifier is a trained network: SQL can't express it. tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if last is not None:
            released(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
