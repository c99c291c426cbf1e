"""A corpus pipeline: toxic documents go, repeated lines go, one document of each near-duplicate group stays, documents
with benchmark passages go, and what is left is packed into batches.

Every stage is written as Parquet in the shared scratch folder and read again by the next. Each takes any rows: null ids
and texts, empty and very long texts, ties, repeated rows, empty tables, further columns of any name, which pass through
all stages but the last. What each does with them stands in its operator's docstring; in short, null and empty texts
are neither toxic nor copies nor leaks and stay, rows with a null id are judged by their text and never grouped, rows
equal in id and text share one fate, and a document whose every line stands in earlier ones goes with its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lectern.llm.decontaminate import without_leaks
from lectern.llm.jaccard_join import near_duplicates_dropped
from lectern.llm.line_dedup import drop_repeated_lines
from lectern.llm.packing import packed
from lectern.llm.shared import table, written
from lectern.llm.toxicity import without_toxic


def toxicity(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(docs, counts=False, emptied=False).select(*docs.columns)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates_dropped(docs)


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Scores of trees and latent spaces can't be said in SQL. The test of the stages holds columns and row counts only;
#: their operators have tests of their own, toxicity by held-out accuracy, the others against SQL or brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
