"""Rows and their open fields: JSON with fallbacks, maps laid over each other, ledgers, ordered events, tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def decoded(text: Column, schema: str, fallback: Column | None = None) -> Column:
    """JSON as a value of ``schema``; ``fallback`` for null, blank and broken text."""
    value = F.from_json(F.when(F.try_parse_json(text).isNotNull(), text), schema)
    return value if fallback is None else F.coalesce(value, fallback)


def encoded(value: Column) -> Column:
    """A value as JSON; null as an empty object."""
    return F.coalesce(F.to_json(value), F.lit("{}"))


def decoded_rows(df: DataFrame, json_columns: dict[str, str], text_columns: list[str]) -> DataFrame:
    """``df`` with JSON columns as values of their schemas and nulls in text columns as blanks."""
    return df.withColumns({c: decoded(F.col(c), s) for c, s in json_columns.items()} | {c: F.coalesce(c, F.lit("")) for c in text_columns})


def overlaid(*maps: Column) -> Column:
    """Maps in one, the later ones holding where keys meet; null maps count as empty."""
    out = F.coalesce(maps[0], F.create_map().cast("map<string,string>"))
    for m in maps[1:]:
        out = _laid_over(out, F.coalesce(m, F.create_map().cast("map<string,string>")))
    return out


def _laid_over(below: Column, above: Column) -> Column:
    return F.map_concat(F.map_filter(below, lambda k, v: ~F.map_contains_key(above, k)), above)


def only(fields: Column, names: list[str]) -> Column:
    """The named fields of a map that aren't null."""
    return F.map_filter(fields, lambda k, v: k.isin(*names) & v.isNotNull())


def pruned(fields: Column) -> Column:
    """A map of JSON values without empty ones."""
    return F.map_filter(fields, lambda k, v: v.isNotNull() & ~F.trim(v).isin("", '""', "null", "[]", "{}"))


def navigated(text: Column, path: str, default: str = "") -> Column:
    """A field inside JSON, or the default where any step is missing."""
    return F.coalesce(F.get_json_object(text, path), F.lit(default))


def with_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose column begins with a prefix, taken literally; the filter reaches the scan."""
    return df.where(F.col(column).startswith(prefix))


def single(df: DataFrame) -> dict | None:
    """The first row as a dictionary."""
    row = df.limit(1).first()
    return row.asDict(recursive=True) if row else None


def runs(ledger: DataFrame, order: str = "event_id") -> DataFrame:
    """Agent runs as they stand: the newest row of each run_id, with ``depth`` 0 for runs without parent and 1 for others."""
    rest = [c for c in ledger.columns if c != "run_id"]
    d = ledger.groupBy("run_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("run_id", "r.*")
    return d.withColumn("depth", F.when(F.coalesce("parent_run_id", F.lit("")) == "", 0).otherwise(1))


def children(ledger: DataFrame) -> DataFrame:
    """(run_id, child_run_id, child_status): runs with their children, a row for each child, or one of nulls."""
    c = ledger.select(F.col("parent_run_id").alias("run_id"), F.col("run_id").alias("child_run_id"), F.col("status").alias("child_status"))
    return ledger.where("coalesce(parent_run_id, '') = ''").select("run_id").join(c, "run_id", "left")


def events_in_order(log: DataFrame, key: list[str], order: str, fields: list[str]) -> DataFrame:
    """(*key, events): each key's events as one array in order; for logs of tasks, which are short."""
    return log.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("events"))


def last_matching(log: DataFrame, key: list[str], order: str, match: Column, fields: list[str]) -> DataFrame:
    """Each key's newest row that matches."""
    return log.where(match).groupBy(*key).agg(F.max_by(F.struct(*fields), order).alias("r")).select(*key, "r.*")


def tally(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows meet each condition, and ``total``."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()])


def latency_ms(started: Column, ended: Column) -> Column:
    return F.greatest(F.lit(0), F.round((F.unix_micros(ended) - F.unix_micros(started)) / 1000)).cast("long")


def event_id(*parts: Column) -> Column:
    """An id made from what tells an event from others, so that a step that runs again writes the same row."""
    return F.concat(F.lit("evt_"), F.left(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), F.lit(32)))


def task_audit(tasks: DataFrame) -> DataFrame:
    """(task_id, status, is_valid, coverage, n_hallucinated) from each task's result JSON; no result: not valid, 0."""
    r = decoded(F.col("result_json"), "citation_audit struct<is_valid boolean, coverage double, hallucinated_ids array<string>>")
    d = tasks.withColumn("__a", r["citation_audit"])
    return d.select(
        "task_id", "status", F.coalesce("__a.is_valid", F.lit(False)).alias("is_valid"), F.coalesce("__a.coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce(F.when(F.col("__a.hallucinated_ids").isNotNull(), F.size("__a.hallucinated_ids")), F.lit(0)).alias("n_hallucinated"),
    )


def artifacts(results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of finished tasks' result JSON: papers (task_id, paper_id, title), the audit, and reviews (task_id, section_id, score)."""
    schema = "papers array<struct<paper_id string, title string>>, reflections array<struct<section_id string, score int>>"
    d = results.withColumn("__r", decoded(F.col("result_json"), schema))
    papers = d.select("task_id", F.explode("__r.papers").alias("p")).select("task_id", "p.paper_id", "p.title").where("paper_id is not null")
    reviews = d.select("task_id", F.explode("__r.reflections").alias("x")).select("task_id", "x.section_id", "x.score")
    return papers, task_audit(results), reviews


def numbered(df: DataFrame, key: list[str], order: str, out: str = "number") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*key).orderBy(order)))


def demo_accounts(spark: SparkSession, tenants: list[tuple[str, str]], users: list[tuple[str, str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """Tenants (id, name) and users (id, tenant, name, password) as active rows, passwords hashed."""
    t = spark.createDataFrame(tenants, "tenant_id string, name string").withColumn("status", F.lit("active"))
    u = spark.createDataFrame(users, "user_id string, tenant_id string, username string, password string")
    return t, u.withColumn("password_hash", F.sha2("password", 256)).withColumn("status", F.lit("active")).drop("password")
