"""Queries of fuzzy names, keyed state, queues and live logs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import batch_ranking, fuzzy, retrieval, scope
from lectern.scratch import read_version, scratch_path, write_version
from lectern.streaming import conversations, expiry, queue, state
from lectern.streaming.logs import drained


def _t(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def citation_suggestions(spark, sf: str) -> DataFrame:
    """For each word of a conversation's users that its assistants never use, the closest words that they do use."""
    d = _t(spark, sf, "conversations")
    w = d.select(F.col("conv_id").alias("doc"), "role", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^\\p{L}\\p{N}]+")).alias("ref")).where("ref <> ''").distinct()
    pool = w.where("role = 'assistant'").select("doc", "ref")
    unknown = w.where("role = 'user'").select("doc", "ref").join(pool, ["doc", "ref"], "left_anti")
    d = fuzzy.close_names(unknown, pool)
    return d.select(F.col("doc").alias("conv_id"), F.col("ref").alias("word"), F.array_join("suggested", " ").alias("suggested"))


def _turns(spark, sf: str) -> DataFrame:
    """Conversations as a stream: what users say, and searches or downloads that their assistants make of it. The table's files come
    in no order of turns, so all are one batch."""
    path = f"{sf}/conversations.parquet"
    d = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a stream takes a file by a pattern only
    status = F.when(F.col("turn") % 4 == 3, "failed").otherwise("succeeded")
    tool = F.when(F.length("text") % 2 == 0, "search_papers").otherwise("acquire_paper_to_knowledge")
    event = F.struct(F.when(F.col("role") == "user", "user").otherwise("tool").alias("kind"), F.col("text").alias("content"), tool.alias("tool_name"), status.alias("status"), F.lit("bad").alias("error"), F.to_json(F.struct(F.col("text").alias("query"))).alias("arguments"))
    return d.select("conv_id", F.col("turn").cast("long").alias("at"), F.to_json(event).alias("event"))


def conversation_latest(spark, sf: str) -> DataFrame:
    """How each conversation stands after its last turn, kept as state by a stream."""
    expiry.use_keyed_state(spark)
    d = drained(conversations.conversation_stream(_turns(spark, sf), "conv_id"), scratch_path(spark, "conversations"), "update")
    d = d.groupBy("conv_id").agg(F.max_by(F.struct("phase", "domain", "last_tool", "error", "goal", "query", "state_version"), "state_version").alias("s"))
    return d.select("conv_id", "s.phase", "s.domain", "s.last_tool", "s.error", F.sha2("s.goal", 256).alias("goal_sha256"), F.sha2("s.query", 256).alias("query_sha256"), "s.state_version")


def tailed_turns(spark, sf: str) -> DataFrame:
    """Turns of each conversation from the second on, up to the first of an assistant with an even length, as a stream gives them."""
    expiry.use_keyed_state(spark)
    path = f"{sf}/conversations.parquet"
    d = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    ends = (F.col("role") == "assistant") & (F.length("text") % 2 == 0)
    d = d.select(F.col("conv_id").alias("task_id"), F.col("turn").cast("long").alias("event_id"), F.when(ends, "completed").otherwise("progress").alias("event"), F.col("text").alias("data"))
    d = drained(queue.tailed(d, after=1), scratch_path(spark, "tail"))
    return d.select(F.col("task_id").alias("conv_id"), "place", F.col("event_id").alias("turn"), "event", F.sha2("data", 256).alias("data_sha256"))


def delivered_jobs(spark, sf: str) -> DataFrame:
    """One job a conversation and role, enqueued, delivered by a stream of the queue, and acknowledged."""
    queue.register(spark)
    expiry.use_keyed_state(spark)
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    d = _t(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"))
    jobs = d.select(F.concat_ws("-", F.col("conv_id").cast("string"), "role").alias("job_id"), F.lit("t").alias("tenant_id"), F.col("role").alias("user_id"), F.col("conv_id").cast("string").alias("task_id"), (F.col("n") % 3).cast("int").alias("attempt"), at.alias("enqueued_at"))
    path = scratch_path(spark, "queue")
    queue.enqueue(jobs, path)
    return drained(queue.delivered(spark, path), scratch_path(spark, "delivered")).select("job_id", "user_id", "task_id", F.col("attempt").cast("long").alias("attempt"))


def tenant_papers(spark, sf: str) -> DataFrame:
    """Papers of one user of one tenant, from a store in which tenants and users have folders of their own."""
    d = _t(spark, sf, "documents").select(F.concat(F.lit("s-"), F.coalesce("source", F.lit(""))).alias("tenant_id"), F.concat(F.lit("u-"), F.coalesce("lang", F.lit(""))).alias("user_id"), "doc_id", F.sha2("text", 256).alias("content_hash"))
    path = scratch_path(spark, "papers")
    write_version(d, path, ("tenant_id", "user_id"))
    store = read_version(spark, path)
    tenant = store.agg(F.min("tenant_id")).first()[0]
    return scope.scoped(store, tenant or "", "u-en").select("tenant_id", "user_id", "doc_id", "content_hash")


def usage_rates(spark, sf: str) -> DataFrame:
    """Rates of model use by kind of event; the sketch's percentile is held against the exact share of calls below it."""
    e = _t(spark, sf, "events").withColumn("k", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)))
    calls = e.select("event_type", (F.col("event_id") % 2 == 0).alias("baseline"), (F.col("k") * F.when(F.col("event_id") % 2 == 0, 3).otherwise(2)).alias("input_tokens"), (F.col("k") % 3 == 0).alias("cached"), (F.col("k") % 5 > 0).alias("cacheable"), F.col("value").alias("latency_ms"))
    d = state.usage_rates(calls, ["event_type"], e.select("event_type", (F.col("k") % 4 == 0).alias("deterministic")), e.where("value > 50").select("event_type", (F.col("k") % 7 == 0).alias("approved"))).drop("latency")
    at = calls.join(F.broadcast(d.select("event_type", "latency_p95")), "event_type").groupBy("event_type").agg(  # one row a kind of event
        F.avg((F.col("latency_ms") < F.col("latency_p95")).cast("double")).alias("below"), F.avg((F.col("latency_ms") <= F.col("latency_p95")).cast("double")).alias("upto"))
    near = (F.col("below") <= 0.95 + 0.014) & (F.col("upto") >= 0.95 - 0.014)
    return d.drop("latency_p95").join(at.select("event_type", near.alias("p95_within")), "event_type")


def bm25_batch(spark, sf: str) -> DataFrame:
    """The ten best documents for each benchmark item, over postings stored in blocks of one language and like lengths."""
    path = scratch_path(spark, "blocks")
    tokens = retrieval.tokens(F.col("text"))
    docs = _t(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), tokens.alias("tokens"), F.size(tokens).alias("length"))
    batch_ranking.write_blocks(docs, path, ["lang", "length"])
    items = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), tokens.alias("tokens"))
    found, _ = batch_ranking.bm25_batch(spark, path, items, 10)
    return found.select(F.col("query_id").alias("item_id"), F.col("rank").cast("long").alias("rank"), "doc_id", "score")


QUERIES = {f.__name__: f for f in (citation_suggestions, conversation_latest, tailed_turns, delivered_jobs, tenant_papers, usage_rates, bm25_batch)}

_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9._/+\-]*')"

ORACLE_SQL = {
    "bm25_batch": f"""WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents), s AS (SELECT count(*) AS n, greatest(avg(len(t)), 1) AS m FROM d),
q AS (SELECT item_id, token, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS}) AS token FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, len(t) AS l, token, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS token FROM d) GROUP BY ALL), f AS (SELECT token, count(*) AS df FROM p GROUP BY token),
b AS (SELECT item_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * l / m))), 6) AS score FROM q JOIN p USING (token) JOIN f USING (token), s GROUP BY item_id, doc_id)
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM b) WHERE rank <= 10""",
    "tenant_papers": """SELECT 's-' || coalesce(source, '') AS tenant_id, 'u-' || coalesce(lang, '') AS user_id, doc_id, sha256(text) AS content_hash FROM documents
WHERE lang = 'en' AND 's-' || coalesce(source, '') = (SELECT min('s-' || coalesce(source, '')) FROM documents)""",
    "usage_rates": """WITH e AS (SELECT *, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k, event_id % 2 = 0 AS b FROM events)
SELECT event_type, count(*) AS calls, round(CAST(sum(3 * k) FILTER (b) - coalesce(sum(2 * k) FILTER (NOT b), 0) AS DOUBLE) / nullif(sum(3 * k) FILTER (b), 0), 4) AS token_saving, round(avg(CAST(k % 4 = 0 AS INT)), 4) AS no_call_rate,
round(CAST(count(*) FILTER (k % 3 = 0 AND k % 5 > 0) AS DOUBLE) / nullif(count(*) FILTER (k % 5 > 0), 0), 4) AS cache_hit_rate, round(CAST(count(*) FILTER (k % 7 = 0 AND value > 50) AS DOUBLE) / nullif(count(*) FILTER (value > 50), 0), 4) AS approval_rate,
true AS p95_within FROM e GROUP BY event_type""",
    "conversation_latest": """WITH e AS (SELECT *, role <> 'user' AS tool, turn % 4 <> 3 AS won, length(text) % 2 = 0 AS search FROM conversations)
SELECT conv_id, max_by(CASE WHEN role = 'user' THEN 'planning' WHEN search THEN CASE WHEN won THEN 'selection_ready' ELSE 'search_failed' END WHEN won THEN 'completed' ELSE 'download_failed' END, turn) AS phase,
CASE WHEN bool_or(tool AND search) THEN 'literature' ELSE 'general' END AS domain, coalesce(max_by(CASE WHEN search THEN 'search_papers' ELSE 'acquire_paper_to_knowledge' END, turn) FILTER (tool AND won), '') AS last_tool,
max_by(CASE WHEN tool AND NOT won THEN 'bad' ELSE '' END, turn) AS error, sha256(coalesce(max_by(left(trim(text), 1000), turn) FILTER (role = 'user'), '')) AS goal_sha256,
sha256(coalesce(max_by(left(text, 500), turn) FILTER (tool AND search), '')) AS query_sha256, count(*) AS state_version FROM e GROUP BY conv_id""",
    "tailed_turns": """WITH e AS (SELECT conv_id, turn, text, CASE WHEN role = 'assistant' AND length(text) % 2 = 0 THEN 'completed' ELSE 'progress' END AS event, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations),
t AS (SELECT conv_id, min(place) FILTER (event = 'completed') AS last FROM e GROUP BY conv_id)
SELECT conv_id, place, CAST(turn AS BIGINT) AS turn, event, sha256(text) AS data_sha256 FROM e JOIN t USING (conv_id) WHERE place >= 1 AND (last IS NULL OR place <= last)""",
    "delivered_jobs": "SELECT conv_id || '-' || role AS job_id, role AS user_id, CAST(conv_id AS VARCHAR) AS task_id, count(*) % 3 AS attempt FROM conversations GROUP BY conv_id, role",
}
