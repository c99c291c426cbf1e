"""Every query by name, and the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.chunks import fixed_chunks as fixed
from lectern.operators import relational as R
from lectern.operators.retrieval import bm25, candidate_limit, hybrid, tokenised, vector_top
from lectern.scratch import scratch_path
from lectern.sources.stored import document_kind
from lectern.streaming.logs import hourly, rate_limited, streamed

QUERY, PREFERENCES, NOW = ["the", "hation", "erblend", "thereon"], ["that", "ention", "worth"], "2026-01-01 00:00:00"


def _t(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bm25_search(spark, sf: str) -> DataFrame:
    d = bm25(tokenised(_t(spark, sf, "documents")), QUERY)
    return d.select("doc_id", F.round("bm25", 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(20)


def hybrid_search(spark, sf: str) -> DataFrame:
    v = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    query = v.where("doc_id = 0").select("embedding").first()
    now = F.lit(NOW).cast("timestamp")
    hits = vector_top(v, query[0], candidate_limit(20))
    age = F.timestamp_micros(F.unix_micros(now) - (F.col("doc_id") % 1000) * F.lit(86_400_000_000))
    d = tokenised(_t(spark, sf, "documents")).withColumns({"published_at": age, "indexed_at": F.lit(None).cast("timestamp")})
    return hybrid(d, hits, QUERY, PREFERENCES, now, 20)


def document_frequency(spark, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))
    return d.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def document_keywords(spark, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"), T.token_estimate(F.col("text")).alias("estimate"))
    return d.select("doc_id", F.array_join(F.slice(F.array_distinct("t"), 1, 20), " ").alias("keywords"), F.size("t").cast("long").alias("n_tokens"), "estimate")


def content_ids(spark, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", F.concat(F.lit("mem_"), F.left(F.sha2(F.concat_ws(":", "source", F.coalesce("text", F.lit(""))), 256), F.lit(32))).alias("content_id"))


def first_wins_texts(spark, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


def keyed_dedupe(spark, sf: str) -> DataFrame:
    return R.first_position_last_value(_t(spark, sf, "events"), ["user_id"], "event_id", ["event_type", "value"])


def last_messages(spark, sf: str) -> DataFrame:
    return R.latest(_t(spark, sf, "conversations").select("conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5")), ["conv_id"], "turn")


def context_parts(spark, sf: str) -> DataFrame:
    return R.head_and_tail(_t(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", 2, 2)


def citation_audit(spark, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select(F.col("event_type").alias("doc"), F.concat(F.lit("see [paper:"), "user_id", F.lit("].")).alias("text"))
    refs = e.select("doc", F.explode(T.cited(F.col("text"))).alias("ref"))
    return R.citation_audit(refs, _t(spark, sf, "customer").select(F.concat(F.lit("paper:"), "c_custkey").alias("ref")))


def pattern_mining(spark, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    return R.mined_patterns(e, ["user_id"], F.col("event_type") != "error", 3, 0.8)


def upserted_orders(spark, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    delta = o.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("archived").alias("o_orderstatus"), "o_orderpriority")
    return R.upsert(o, delta, ["o_orderkey"])


def scoped_customers(spark, sf: str) -> DataFrame:
    c, n = _t(spark, sf, "customer"), _t(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).where("c_acctbal > 0").select("c_custkey", "c_name", "n_name")


def state_versions(spark, sf: str) -> DataFrame:
    return R.numbered(_t(spark, sf, "events").select("event_id", "user_id"), ["user_id"], "event_id", "state_version")


def page_links(spark, sf: str) -> DataFrame:
    p = _t(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('<a href="([^"]*)"'), 1)).alias("pos", "url"))
    return p.groupBy("page_id", "url").agg(F.min("pos").cast("long").alias("pos"))


def query_overlap(spark, sf: str) -> DataFrame:
    q = F.array(*[F.lit(x) for x in QUERY + PREFERENCES])
    return _t(spark, sf, "documents").select("doc_id", F.round(T.overlap(T.tokens(F.col("text")), q), 6).alias("jaccard"))


def fixed_chunks(spark, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", F.posexplode(fixed(F.col("text"))).alias("chunk_index", "chunk"))
    return d.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.sha2("chunk", 256).alias("content_hash"))


def term_frequency(spark, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    return d.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"))


def pool_coverage(spark, sf: str) -> DataFrame:
    cited = _t(spark, sf, "orders").select(F.col("o_custkey").alias("ref"))
    return R.coverage(cited, _t(spark, sf, "customer").select(F.col("c_custkey").alias("ref")))


def registry_changes(spark, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    old, new = o.where("o_orderkey % 5 <> 0"), o.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")))
    return R.changes(old, new, "o_orderkey", "o_orderstatus")


def page_kinds(spark, sf: str) -> DataFrame:
    return _t(spark, sf, "pages").select("page_id", document_kind(F.col("html").cast("binary")).alias("kind"))


def admitted_events(spark, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select("event_id", "user_id", "ts")
    return rate_limited(e, "user_id", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, ["event_id"], limit=2, window=86_400.0).select("event_id", "user_id", "allowed")


def hourly_events(spark, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")  # a stream takes a file by a pattern only
    # the table's files come in no order of time, so all are one batch, and nothing in it is late; hours are forgotten after it
    return streamed(stream, scratch_path(spark, "hourly"), lambda e: hourly(e, "ts", "event_type"), ["hour", "event_type"])


QUERIES = {
    f.__name__: f
    for f in (
        bm25_search, hybrid_search, document_frequency, document_keywords, content_ids, first_wins_texts, keyed_dedupe, last_messages, context_parts, citation_audit,
        pattern_mining, upserted_orders, scoped_customers, state_versions, page_links, query_overlap, fixed_chunks, term_frequency,
        pool_coverage, registry_changes, page_kinds, admitted_events, hourly_events,
    )
}

_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9._/+\-]*')"
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_BM25 = f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents), s AS (SELECT count(*) AS n, greatest(avg(len(t)), 1) AS m FROM d),
q AS (SELECT unnest({_LIST(QUERY)}) AS term), f AS (SELECT term, (SELECT count(*) FROM d WHERE list_contains(t, term)) AS df FROM q),
p AS (SELECT doc_id, len(t) AS l, term, df, CAST(len(list_filter(t, lambda x: x = term)) AS DOUBLE) AS tf FROM d, f),
b AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * l / m))) AS bm FROM p, s GROUP BY doc_id)
"""

ORACLE_SQL = {
    "bm25_search": _BM25 + "SELECT doc_id, round(bm, 6) AS score FROM b WHERE round(bm, 6) > 0 ORDER BY score DESC, doc_id LIMIT 20",
    "hybrid_search": _BM25 + f""", v AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
h AS (SELECT doc_id, row_number() OVER (ORDER BY list_cosine_similarity(e, (SELECT e FROM v WHERE doc_id = 0)) DESC, doc_id) AS rank FROM v ORDER BY rank LIMIT 80),
x AS (SELECT d.doc_id, coalesce(1.0 / rank, 0) AS vector, bm / (SELECT max(bm) FROM b) AS bm25, exp(-0.6931471805599453 * (d.doc_id % 1000) / 365.0) AS temporal,
  len(list_intersect(t, {_LIST(PREFERENCES)})) / {len(PREFERENCES)}.0 AS preference FROM d JOIN b USING (doc_id) LEFT JOIN h USING (doc_id) WHERE bm > 0 OR rank IS NOT NULL),
y AS (SELECT *, 0.35 * vector + 0.40 * bm25 + 0.10 * temporal + 0.15 * preference AS score FROM x ORDER BY score DESC, doc_id LIMIT 20)
SELECT doc_id, round(vector, 6) AS vector, round(bm25, 6) AS bm25, round(temporal, 6) AS temporal, round(preference, 6) AS preference, round(score, 6) AS score FROM y""",
    "document_frequency": f"SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY token",
    "document_keywords": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x, {_TOKENS} AS t FROM documents)
SELECT doc_id, array_to_string(list_filter(t, lambda w, i: list_position(t, w) = i)[1:20], ' ') AS keywords, len(t) AS n_tokens, greatest(1, length(x) // 4) AS estimate FROM d""",
    "content_ids": "SELECT doc_id, 'mem_' || left(sha256(concat_ws(':', source, coalesce(text, ''))), 32) AS content_id FROM documents",
    "first_wins_texts": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY coalesce(text, '')",
    "keyed_dedupe": "SELECT user_id, min(event_id) AS first_position, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id",
    "last_messages": "SELECT conv_id, turn, role, md5(coalesce(text, '')) AS text_md5 FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "context_parts": """SELECT conv_id, turn, role, CASE WHEN row_number() OVER w <= 2 THEN 'head' WHEN row_number() OVER w > count(*) OVER (PARTITION BY conv_id) - 2 THEN 'tail' ELSE 'middle' END AS part
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "citation_audit": """SELECT event_type AS doc, count(*) AS n_cited, count(*) FILTER (c_custkey IS NULL) AS n_hallucinated, count(*) FILTER (c_custkey IS NULL) = 0 AS is_valid
FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY event_type""",
    "pattern_mining": """SELECT * FROM (SELECT user_id, count(*) FILTER (event_type <> 'error') AS successes, count(*) FILTER (NOT event_type <> 'error') AS failures,
round(count(*) FILTER (event_type <> 'error') / (count(*) FILTER (event_type <> 'error') + count(*) FILTER (NOT event_type <> 'error')), 4) AS success_rate FROM events GROUP BY user_id)
WHERE successes >= 3 AND success_rate >= 0.8""",
    "upserted_orders": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'archived' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders",
    "scoped_customers": "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0",
    "state_versions": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS state_version FROM events",
    "page_links": """SELECT page_id, url, min(pos) AS pos FROM (SELECT page_id, unnest(l) AS url, unnest(range(len(l))) AS pos
FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<a href="([^"]*)"', 1) AS l FROM pages)) GROUP BY page_id, url""",
    "query_overlap": f"""WITH d AS (SELECT doc_id, list_distinct({_TOKENS}) AS t FROM documents), o AS (SELECT doc_id, len(t) AS n, len(list_intersect(t, {_LIST(QUERY + PREFERENCES)})) AS i FROM d)
SELECT doc_id, round(CAST(i AS DOUBLE) / (n + {len(set(QUERY + PREFERENCES))} - i), 6) AS jaccard FROM o""",
    "fixed_chunks": """WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents),
c AS (SELECT doc_id, unnest(list_filter(list_transform(range(0, greatest(length(t), 1), 780), lambda i: trim(substring(t, i + 1, 900))), lambda x: x <> '')) AS chunk,
  generate_subscripts(list_filter(list_transform(range(0, greatest(length(t), 1), 780), lambda i: trim(substring(t, i + 1, 900))), lambda x: x <> ''), 1) - 1 AS chunk_index FROM d)
SELECT doc_id, chunk_index, sha256(chunk) AS content_hash FROM c""",
    "term_frequency": f"SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY doc_id, token",
    "pool_coverage": """SELECT count(*) AS n_pool, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS n_covered,
round(count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) / count(*), 4) AS coverage FROM customer""",
    "registry_changes": """WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0)
SELECT o_orderkey, CASE WHEN a.o_orderstatus IS NULL THEN 'added' WHEN b.o_orderstatus IS NULL THEN 'removed' ELSE 'updated' END AS change
FROM a FULL JOIN b USING (o_orderkey) WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""",
    "page_kinds": """SELECT page_id, CASE WHEN html IS NULL OR NOT (contains(h, '<html') OR contains(h, '<!doctype')) THEN 'unknown'
WHEN regexp_matches(t, '登录|login|captcha|验证码|无权|购买') THEN 'login' ELSE 'page' END AS kind
FROM (SELECT page_id, html, lower(decode(encode(html)[1:1024], 'replace')) AS h, lower(decode(encode(html)[1:8192], 'replace')) AS t FROM pages)""",
    "admitted_events": """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT event_id, user_id, n, true AS allowed, [ts] AS kept FROM e WHERE n = 1
  UNION ALL SELECT e.event_id, e.user_id, e.n, len(list_filter(r.kept, lambda t: t >= e.ts - INTERVAL 1 DAY)) < 2,
    CASE WHEN len(list_filter(r.kept, lambda t: t >= e.ts - INTERVAL 1 DAY)) < 2 THEN list_append(list_filter(r.kept, lambda t: t >= e.ts - INTERVAL 1 DAY), e.ts)
    ELSE list_filter(r.kept, lambda t: t >= e.ts - INTERVAL 1 DAY) END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT event_id, user_id, allowed FROM r""",
    "hourly_events": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
}
