"""A survey from papers to a report, as tables: dedupe, batches, outline, sections, audit, references, report, scores.

Texts of sections are input (what a model wrote, or the template that stands in for one); everything else follows from
the papers. A topic's papers are a page of results, so its lists are arrays; topics are spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import citation, token_estimate
from lectern.operators import citations as C
from lectern.operators.batches import batched
from lectern.scratch import stored

#: Phases in order, with the percentage at which each is reported.
PHASES = (("ingest", 5), ("search", 20), ("batch", 35), ("outline", 45), ("sections", 70), ("audit", 80), ("format", 90), ("completed", 100))


def progress(topics: DataFrame) -> DataFrame:
    """(topic_id, event_id, event, phase, percent) of each topic's run."""
    p = F.array(*[F.struct(F.lit(i).alias("event_id"), F.lit("completed" if n == "completed" else "progress").alias("event"), F.lit(n).alias("phase"), F.lit(v).alias("percent")) for i, (n, v) in enumerate(PHASES)])
    return topics.select("topic_id", F.explode(p).alias("p")).select("topic_id", "p.*")


def distinct_papers(papers: DataFrame) -> DataFrame:
    """Papers (topic_id, position, paper_id, title, abstract, authors, source, published_at): one a topic and id, at its first place with its last values."""
    rest = [c for c in papers.columns if c not in ("topic_id", "paper_id", "position")]
    d = papers.groupBy("topic_id", "paper_id").agg(F.min("position").alias("position"), F.max_by(F.struct(*rest), "position").alias("r"))
    return d.select("topic_id", "position", "paper_id", "r.*")


def outlines(papers: DataFrame, budget: int = 4000) -> DataFrame:
    """(topic_id, sections): outlines over greedy batches of each topic's papers."""
    tokens = token_estimate(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))))
    b = batched(papers, ["topic_id"], "position", "paper_id", tokens, budget)
    b = b.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("batch", "ids"))), lambda x: x["ids"]).alias("batches"))
    return b.select("topic_id", C.outline(F.col("batches")).alias("sections"))


def drafts(topics: DataFrame, outline: DataFrame) -> DataFrame:
    """(topic_id, position, section_id, title, content): sections by template, each citing its first paper."""
    d = topics.select("topic_id", "topic").join(outline, "topic_id").select("topic_id", "topic", F.posexplode("sections").alias("position", "s"))
    text = C.template(F.lit("section"), F.col("topic"), F.col("s.title"), F.get("s.paper_ids", F.lit(0)), F.lit(""))
    return d.select("topic_id", "position", "s.section_id", "s.title", text.alias("content"))


def reports(topics: DataFrame, papers: DataFrame, sections: DataFrame, style: str = "IEEE") -> DataFrame:
    """(topic_id, markdown, is_valid, coverage, score, passed): each topic's report with its audit and its references."""
    text = sections.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("position", "title", "content"))).alias("s"))
    whole = text.select(F.col("topic_id").alias("doc"), F.array_join(F.transform("s", lambda x: x["content"]), "\n").alias("text"))
    audit = C.verified(whole, papers.select(F.col("topic_id").alias("doc"), F.col("paper_id").alias("ref"))).withColumnRenamed("doc", "topic_id")
    used = audit.select("topic_id", F.explode(F.array_distinct("found_ids")).alias("paper_id"))
    cited = papers.join(used, ["topic_id", "paper_id"], "left_semi")
    line = citation(F.lit(style), F.col("authors"), F.col("title"), F.col("source"), F.col("published_at"))
    refs = cited.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("l")))), lambda x: x["l"]).alias("refs"))
    d = topics.select("topic_id", "topic").join(text, "topic_id", "left").join(refs, "topic_id", "left").join(audit, "topic_id", "left")
    parts = F.coalesce(F.transform("s", lambda x: F.struct(x["title"].alias("title"), x["content"].alias("content"))), F.array().cast("array<struct<title:string,content:string>>"))
    lines = F.coalesce("refs", F.array().cast("array<string>"))
    d = d.withColumn("markdown", C.report_markdown(F.col("topic"), parts, lines)).withColumn("r", C.report_score(F.col("markdown"), F.col("is_valid"), F.size(lines)))
    return d.select("topic_id", "markdown", F.coalesce("is_valid", F.lit(False)).alias("is_valid"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "r.score", "r.passed")


def surveys(topics: DataFrame, papers: DataFrame, write: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None, retries: int = 1) -> DataFrame:
    """Reports of ``topics`` (topic_id, topic). ``write(topics, outline, attempt)`` gives sections; topics whose report
    doesn't pass are written again, ``retries`` times at most, and the last report stands."""
    p = stored(distinct_papers(papers), "papers")
    o = stored(outlines(p), "outlines")
    make = write or (lambda t, outline, attempt: drafts(t, outline))
    done, todo = None, topics
    for attempt in range(retries + 1):
        r = stored(reports(todo, p, make(todo, o, attempt)), "reports")
        good = r if attempt == retries else r.where("passed")
        done = good if done is None else done.unionByName(good)
        if attempt == retries:
            break
        todo = topics.join(r.where("not passed").select("topic_id"), "topic_id", "left_semi")
    return done
