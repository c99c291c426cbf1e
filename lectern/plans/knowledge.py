"""The tools over a store of papers: each reads and writes tables under a root folder, as whole versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.chunks import build_chunks
from lectern.operators import citations, keyed, scope
from lectern.operators.collections import prioritised_union
from lectern.plans.tools import tool
from lectern.scratch import read_version, write_version

PAPER = "tenant_id string, user_id string, paper_id string, source string, title string, abstract string, full_text string, published_at string, in_knowledge_base boolean, created_at timestamp, updated_at timestamp"
KEY = ["tenant_id", "user_id", "paper_id"]


def papers(spark: SparkSession, root: str) -> DataFrame:
    try:
        return read_version(spark, f"{root}/papers")
    except ValueError:
        return spark.createDataFrame([], PAPER)


def chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of the papers that are in the knowledge base: derived, so what leaves the table leaves the search."""
    return build_chunks(keyed.members(papers(spark, root)))


@tool("save_to_knowledge", "Store papers; known ones keep their creation time", "knowledge", "medium")
def save_to_knowledge(spark: SparkSession, tenant_id: str, user_id: str, root: str, rows: DataFrame) -> DataFrame:
    own = rows.withColumn("tenant_id", F.lit(tenant_id)).withColumn("user_id", F.lit(user_id))
    for c, kind in (x.split() for x in PAPER.split(", ")):
        own = own.withColumn(c, (F.col(c) if c in own.columns else F.lit(True) if c == "in_knowledge_base" else F.lit(None)).cast(kind))
    last = keyed.last_of_each(own, KEY, ["updated_at", "title"])
    write_version(keyed.upsert_keeping(papers(spark, root), last.select(*[x.split()[0] for x in PAPER.split(", ")]), KEY, ["created_at"]), f"{root}/papers")
    return scope.scoped(papers(spark, root), tenant_id, user_id).join(last.select(*KEY), KEY, "left_semi")


@tool("search_papers", "Search a user's papers, then other sources in order, until there are enough", "search")
def search_papers(spark: SparkSession, tenant_id: str, user_id: str, root: str, query: str = "", limit: int = 12, others: tuple = ()) -> DataFrame:
    own = lambda n: scope.found_by(scope.scoped(papers(spark, root), tenant_id, user_id), query, ["title", "abstract", "paper_id"], [F.desc("updated_at"), F.col("paper_id")], n).select("paper_id", "source", "title")
    found, _ = prioritised_union([("local", own), *others], "paper_id", limit)
    return found


@tool("verify_citations", "Audit what a text cites against a user's papers", "citation")
def verify_citations(spark: SparkSession, tenant_id: str, user_id: str, root: str, text: str) -> DataFrame:
    pool = scope.scoped(papers(spark, root), tenant_id, user_id).select(F.lit(0).alias("doc"), F.col("paper_id").alias("ref"))
    return citations.verified(spark.createDataFrame([(0, text)], "doc int, text string"), pool)


@tool("delete_knowledge", "Delete papers of a user", "knowledge", "high")
def delete_knowledge(spark: SparkSession, tenant_id: str, user_id: str, root: str, ids: list) -> DataFrame:
    before = papers(spark, root)
    gone = spark.createDataFrame([(tenant_id, user_id, i) for i in ids], "tenant_id string, user_id string, paper_id string")
    found = before.join(gone, KEY, "left_semi").select(*KEY)
    found = spark.createDataFrame(found.collect(), found.schema)  # the ids that were named
    write_version(keyed.deleted(before, gone, KEY), f"{root}/papers")
    return found


@tool("toggle_knowledge_base", "Take papers in or out of search", "knowledge", "medium")
def toggle_knowledge_base(spark: SparkSession, tenant_id: str, user_id: str, root: str, ids: list, on: bool) -> DataFrame:
    to = spark.createDataFrame([(tenant_id, user_id, i, on) for i in ids], "tenant_id string, user_id string, paper_id string, in_knowledge_base boolean")
    write_version(keyed.updated_columns(papers(spark, root), to, KEY, ["in_knowledge_base"]), f"{root}/papers")
    return papers(spark, root).join(to.select(*KEY), KEY, "left_semi")
