"""Citations and reports: what a text cites against its pool, close names of unknown ids, references, outlines, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import cited
from lectern.operators.fuzzy import close_names


def verified(texts: DataFrame, pool: DataFrame) -> DataFrame:
    """For each of ``texts`` (doc, text), against its own part of ``pool`` (doc, ref): ids found, those not in the pool
    (both in order, with repeats), pool ids that aren't cited (sorted), coverage to four digits, and validity.

    Joins are by (doc, ref), so a text meets its own pool alone. A text without pool or citations has coverage 0 and is
    valid as long as it cites nothing.
    """
    refs = texts.select("doc", F.posexplode(cited(F.col("text"))).alias("pos", "ref"))
    own = pool.select("doc", "ref").where("ref is not null").distinct()
    known = refs.join(own.withColumn("__k", F.lit(True)), ["doc", "ref"], "left")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["ref"])
    found = known.groupBy("doc").agg(in_order(F.struct("pos", "ref")).alias("found_ids"), in_order(F.when(F.col("__k").isNull(), F.struct("pos", "ref"))).alias("hallucinated_ids"))
    seen = own.join(refs.select("doc", "ref").distinct().withColumn("__c", F.lit(True)), ["doc", "ref"], "left")
    missing = seen.groupBy("doc").agg(F.count(F.lit(1)).alias("__n"), F.count("__c").alias("__covered"), F.array_sort(F.collect_list(F.when(F.col("__c").isNull(), F.col("ref")))).alias("missing_reference_ids"))
    none = F.array().cast("array<string>")
    d = texts.select("doc").join(found, "doc", "left").join(missing, "doc", "left")
    return d.select(
        "doc", *[F.coalesce(c, none).alias(c) for c in ("found_ids", "hallucinated_ids", "missing_reference_ids")],
        F.when(F.col("__n") > 0, F.round(F.col("__covered") / F.col("__n"), 4)).otherwise(0.0).alias("coverage"), (F.coalesce(F.size("hallucinated_ids"), F.lit(0)) <= 0).alias("is_valid"),
    )


def suggestions(audit: DataFrame, pool: DataFrame) -> DataFrame:
    """(doc, ref, suggested) for each distinct unknown id of an audit: the closest ids of the text's own pool, three at most."""
    bad = audit.select("doc", F.explode(F.array_distinct("hallucinated_ids")).alias("ref"))
    return close_names(bad, pool).select("doc", "ref", "suggested")


def cited_papers(texts: DataFrame, papers: DataFrame, key: str = "paper_id") -> DataFrame:
    """The papers that any text cites."""
    refs = texts.select(F.explode(cited(F.col("text"))).alias(key)).distinct()
    return papers.join(refs, key, "left_semi")


def numbered_references(references: DataFrame, report: str, order: str, text: str) -> DataFrame:
    """Adds ``number``, from 1 in each report, and ``line``."""
    n = F.row_number().over(Window.partitionBy(report).orderBy(order))
    return references.withColumn("number", n).withColumn("line", F.format_string("%d. %s", "number", text))


def section_score(content: Column, valid: Column) -> Column:
    """(score, passed, findings): 90 less 35 for unknown citations and 10 for under 120 characters."""
    return _scored(90, 85, [(~F.coalesce(valid, F.lit(False)), 35, "section contains unsupported citation ids"), (F.char_length(F.coalesce(content, F.lit(""))) < 120, 10, "section is too short")])


def report_score(markdown: Column, valid: Column, n_references: Column) -> Column:
    """(score, passed, findings): 100 less 50 for an empty report, 40 for a failed audit and 10 for no references."""
    blank = F.trim(F.coalesce(markdown, F.lit(""))) == ""
    return _scored(100, 85, [
        (blank, 50, "final markdown is empty"), (~F.coalesce(valid, F.lit(False)), 40, "citation audit did not pass"), (F.coalesce(n_references, F.lit(0)) == 0, 10, "no references generated"),
    ])


def _scored(start: int, least: int, faults: list[tuple[Column, int, str]]) -> Column:
    score = F.lit(start)
    for bad, cost, _ in faults:
        score = score - F.when(bad, cost).otherwise(0)
    findings = F.filter(F.array(*[F.when(bad, F.lit(text)) for bad, _, text in faults]), lambda x: x.isNotNull())
    return F.struct(F.greatest(score, F.lit(0)).alias("score"), (score >= least).alias("passed"), findings.alias("findings"))


def outline(batches: Column) -> Column:
    """Four sections with papers, from an array of batches of paper ids."""
    def heads(n: int, most: int) -> Column:
        return F.slice(F.flatten(F.transform(batches, lambda b: F.slice(b, 1, n))), 1, most)

    tails = F.slice(F.flatten(F.transform(batches, lambda b: F.slice(b, F.greatest(F.size(b) - 1, F.lit(1)), F.lit(2)))), 1, 5)
    first = F.coalesce(F.slice(F.get(batches, F.lit(0)), 1, 3), F.array().cast("array<string>"))
    # The sections' ids and titles.
    parts = (
        ("background", "Research Background and Motivation", first), ("methods", "Method Families and Technical Evolution", heads(2, 5)),
        ("evaluation", "Evaluation, Risks, and Open Problems", tails), ("future", "Future Directions", heads(1, 4)),
    )
    return F.array(*[F.struct(F.lit(i).alias("section_id"), F.lit(t).alias("title"), p.alias("paper_ids")) for i, t, p in parts])


def outline_titles(markdown: Column) -> Column:
    """Titles of an edited outline: headings below the first level and numbered lines, without their numbers."""
    number, heading = "^\\d+[.、)]\\s+(.+)$", "^#{2,6}\\s+(.+)$"

    def title(line: Column) -> Column:
        bare = F.when(line.rlike(heading), F.trim(F.regexp_extract(line, heading, 1))).when(line.rlike("^#"), None).when(line.rlike(number), line)
        return F.trim(F.when(bare.rlike(number), F.regexp_extract(bare, number, 1)).otherwise(bare))

    lines = F.transform(F.split(F.coalesce(markdown, F.lit("")), "\r\n|\n|\r"), lambda x: title(F.trim(x)))
    return F.filter(lines, lambda t: t.isNotNull() & (t != "") & ~F.lower(t).startswith("survey outline"))


def edited_outline(original: Column, titles: Column) -> Column:
    """Sections under new titles: by place, and past the end with the last section's papers and id. No titles: as before."""
    none = F.struct(F.lit(None).cast("string").alias("section_id"), F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("paper_ids"))

    def section(t: Column, i: Column) -> Column:
        base = F.coalesce(F.get(original, F.least(i, F.size(original) - 1)), none)
        return F.struct(F.coalesce(F.nullif(base["section_id"], F.lit("")), F.concat(F.lit("custom_"), (i + 1).cast("string"))).alias("section_id"), t.alias("title"), base["paper_ids"].alias("paper_ids"))

    return F.when(F.size(titles) > 0, F.transform(titles, section)).otherwise(original)


def outline_markdown(topic: Column, titles: Column) -> Column:
    lines = F.transform(titles, lambda t, i: F.concat(F.lit("## "), (i + 1).cast("string"), F.lit(". "), t))
    return F.array_join(F.concat(F.array(F.concat(F.lit("# Survey Outline: "), topic)), lines), "\n")


def report_markdown(topic: Column, sections: Column, references: Column) -> Column:
    """A report of sections (title, content) and numbered references, ended by a line feed."""
    body = F.flatten(F.transform(sections, lambda s: F.filter(F.array(F.when(F.trim(F.coalesce(s["title"], F.lit(""))) != "", F.concat(F.lit("## "), F.trim(s["title"]))), F.trim(s["content"]), F.lit("")), lambda x: x.isNotNull())))
    refs = F.transform(references, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r))
    lines = F.concat(F.array(F.concat(F.lit("# Survey on "), topic), F.lit("")), body, F.array(F.lit("## References")), refs)
    return F.concat(F.trim(F.array_join(lines, "\n")), F.lit("\n"))


def template(purpose: Column, topic: Column, section: Column, citation: Column, prompt: Column) -> Column:
    """What stands in for a model: fixed texts for outlines, sections and critics, else the head of the prompt."""
    topic = F.coalesce(F.nullif(topic, F.lit("")), F.lit("the selected research topic"))
    # The texts of the three purposes.
    outline_text = "# Survey Outline: %s\n## 1. Research Background and Motivation\n## 2. Method Families and Technical Evolution\n## 3. Evaluation, Risks, and Open Problems\n## 4. Future Directions"
    section_text = (
        "### %s\n\nRecent work on %s shows a shift from isolated techniques to pipeline-level systems with measurable reliability constraints [%s]. The reviewed literature also indicates that "
        "deployment quality depends on data governance, evaluation design, and traceable citation practices."
    )
    critic = "The section is acceptable if every factual claim keeps a source ID and avoids unsupported comparison."
    return (
        F.when(purpose == "outline", F.format_string(outline_text, topic))
        .when(purpose == "section", F.format_string(section_text, F.coalesce(section, F.lit("Research Background")), topic, F.coalesce(citation, F.lit("paper:local:seed"))))
        .when(purpose == "critic", critic).otherwise(F.left(prompt, F.lit(1200)))
    )
