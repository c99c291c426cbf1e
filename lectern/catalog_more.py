"""More queries by name and their SQL: chunks and vectors, memories, citations, writes, states, routing and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import chunks as C
from lectern.functions import text as T
from lectern.functions import vectors as V
from lectern.operators import batches, citations, collections, keyed, memory, relational, retrieval, scope
from lectern.plans import context, dag, routing
from lectern.scratch import scratch_path, stored
from lectern.streaming import conversations, state

NOW = "2026-01-01 00:00:00"
QUERY = ["the", "hation", "erblend", "thereon"]
MEMORY_QUERY = "the and of that hation erblend"


def _t(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _now():
    return F.lit(NOW).cast("timestamp")


def _papers(spark, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select(
        F.coalesce("source", F.lit("")).alias("tenant_id"), F.coalesce("lang", F.lit("")).alias("user_id"), F.col("doc_id").cast("string").alias("paper_id"), F.format_string("Paper %d", "doc_id").alias("title"),
        F.lit(None).cast("string").alias("abstract"), F.col("text").alias("full_text"), F.lit(None).cast("string").alias("published_at"), "doc_id",
    )


def chunk_table(spark, sf: str) -> DataFrame:
    d = C.build_chunks(_papers(spark, sf), "fixed")
    return d.select("chunk_id", "paper_id", "chunk_index", "content_hash", "token_count", F.array_join("keywords", " ").alias("keywords"))


def chunk_paragraph(spark, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", F.posexplode(C.paragraph_chunks(F.col("text"))).alias("chunk_index", "chunk"))
    return d.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.sha2("chunk", 256).alias("content_hash"))


def lexical_embedding(spark, sf: str) -> DataFrame:
    d = stored(_t(spark, sf, "benchmark").select("item_id", V.lexical_embedding(F.col("text"), 128).alias("v")), "vectors")
    return d.select("item_id", F.size("v").alias("dimensions"), F.round(V.norm(F.col("v")), 4).alias("length"), F.md5(F.array_join(F.transform("v", lambda x: F.format_number(x, 6)), " ")).alias("digest"))


def hash_embedding(spark, sf: str) -> DataFrame:
    return _t(spark, sf, "benchmark").select("item_id", F.posexplode(V.hash_embedding(F.col("text"))).alias("place", "share"))


def vector_topk(spark, sf: str) -> DataFrame:
    v = _t(spark, sf, "embeddings").select("vec_id", "embedding")
    query = v.where("vec_id = 7").select("embedding").first()[0]
    return retrieval.vector_top(v, query, 20, ("vec_id",)).select("vec_id", F.col("rank").cast("long").alias("rank"), V.distance_score(1 - F.col("cosine")).alias("score"))


def bm25_postings(spark, sf: str) -> DataFrame:
    path = scratch_path(spark, "postings")
    retrieval.write_postings(retrieval.tokenised(_t(spark, sf, "documents")), path, files=8)
    return retrieval.bm25_of_postings(spark, path, QUERY).select("doc_id", F.round("bm25", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


def rag_stats(spark, sf: str) -> DataFrame:
    d = _papers(spark, sf).select("tenant_id", "user_id", "paper_id", F.explode(C.fixed_chunks(F.col("full_text"))).alias("chunk"))
    return retrieval.index_stats(d, ["tenant_id", "user_id"], "paper_id")


def temporal_decay(spark, sf: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    return _t(spark, sf, "orders").select("o_orderkey", F.round(T.decay(at, _now(), 365.0), 6).alias("half_life"), F.round(T.recency(at, _now(), 900.0), 6).alias("e_fold"))


def _memories(spark, sf: str) -> DataFrame:
    d = _t(spark, sf, "conversations")
    return d.select(
        F.concat(F.lit("m"), (F.col("conv_id") * 100 + F.col("turn")).cast("string")).alias("memory_id"), F.lit("t").alias("tenant_id"), F.col("role").alias("user_id"), F.lit("preference").alias("memory_type"),
        F.coalesce("text", F.lit("")).alias("content"), T.normalised_memory(F.col("text")).alias("normalized_content"), (F.lit(0.5) + (F.col("turn") % 5) / 10).cast("double").alias("importance"),
        F.lit(1.0).alias("confidence"), F.lit(0).cast("long").alias("access_count"), F.lit(None).cast("timestamp").alias("last_accessed_at"), F.when(F.col("turn") == 3, "forgotten").otherwise("active").alias("status"),
        _now().alias("created_at"), F.timestamp_micros(F.unix_micros(_now()) - (F.col("conv_id") % 90) * F.lit(86_400_000_000)).alias("updated_at"),
    )


def memory_recall(spark, sf: str) -> DataFrame:
    asked = _t(spark, sf, "conversations").select("role").distinct().select(F.lit("t").alias("tenant_id"), F.col("role").alias("user_id"), F.lit(MEMORY_QUERY).alias("query"))
    return memory.recalled(_memories(spark, sf), asked, _now(), 8).select("user_id", "memory_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def memory_touched(spark, sf: str) -> DataFrame:
    m = _memories(spark, sf)
    d = memory.touched(memory.forgotten(m, m.where("importance > 0.85"), _now()), m.where("importance < 0.55"), _now())
    return d.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("access_count").alias("accesses"))


def citation_report(spark, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("doc"))
    ref = lambda m: F.concat(F.lit("[paper:"), (F.col("doc") % m).cast("string"), F.lit("] "))
    texts = d.select("doc", F.concat(F.lit("see "), ref(7), ref(11), ref(7), F.lit("end")).alias("text"))
    pool = d.select("doc", F.explode(F.sequence(F.lit(0), F.col("doc") % 9)).alias("i")).where("i > 0").select("doc", F.concat(F.lit("paper:"), F.col("i").cast("string")).alias("ref"))
    r = citations.verified(texts, pool)
    return r.select("doc", *[F.array_join(c, ",").alias(c) for c in ("found_ids", "hallucinated_ids", "missing_reference_ids")], "coverage", "is_valid")


def citation_format(spark, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    style = F.element_at(F.array(F.lit("IEEE"), F.lit("APA"), F.lit("GB/T 7714")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return o.select("o_orderkey", T.citation(style, F.array("c_name"), F.col("o_orderpriority"), F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("reference"))


def tool_history(spark, sf: str) -> DataFrame:
    users = _t(spark, sf, "customer").select("c_custkey")
    log = _t(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("c_custkey"))
    return keyed.has_any(users, log, ["c_custkey"], "failed_once")


def priority_union(spark, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    source = lambda lang, most: lambda n: d.where(F.col("lang") == lang).select("doc_id", "lang").orderBy("doc_id").limit(min(n, most))
    found, _ = collections.prioritised_union([("de", source("de", 5)), ("again", source("de", 5)), ("fr", source("fr", 4)), ("en", source("en", 50)), ("es", source("es", 50))], "doc_id", 20)
    return found


def recent_artifacts(spark, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return collections.recent_distinct(e, ["user_id"], "event_type", "event_id", 2)


def merged_events(spark, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select("user_id", F.col("event_id").alias("position"), F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("c"), (F.col("event_id") % 4).cast("string"))).alias("call_id"), F.col("event_type").alias("status"))
    part = lambda i: e.where(F.col("position") % 3 == i)
    return collections.merged_events(part(0), part(1), part(2), "user_id").withColumn("place", F.col("place").cast("long"))


def literature_batches(spark, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").withColumn("lang", F.coalesce("lang", F.lit("")))
    b = batches.batched(d, ["source", "lang"], "doc_id", "doc_id", T.token_estimate(F.col("text")))
    return b.select("source", "lang", F.col("batch").cast("long").alias("batch"), F.array_join("ids", ",").alias("ids"))


def substring_search(spark, sf: str) -> DataFrame:
    d = scope.filtered(_t(spark, sf, "documents"), lang="en", source=None)
    return scope.found_by(d, "HATION", ["text"], [F.desc("doc_id")], 25).select("doc_id", "source")


def soft_deleted_orders(spark, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return keyed.marked(o, o.where("o_orderkey % 5 = 0"), ["o_orderkey"], "o_orderstatus", "forgotten")


def deleted_orders(spark, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return keyed.deleted(o, o.where("o_orderkey % 3 = 0"), ["o_orderkey"], F.col("o_orderstatus").isin("F", "O"))


def kept_columns(spark, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    delta = c.where("c_custkey % 4 = 0").select((F.col("c_custkey") + F.when(F.col("c_custkey") % 8 == 0, 1_000_000).otherwise(0)).alias("c_custkey"), F.lit("new").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return keyed.upsert_keeping(c, delta, ["c_custkey"], ["c_acctbal"], {"c_acctbal": F.lit(-1.0)})


def updated_columns(spark, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    delta = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("ignored").alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, "X").alias("c_mktsegment"))
    return keyed.updated_columns(c, delta, ["c_custkey"], ["c_mktsegment"])


def replaced_lines(spark, sf: str) -> DataFrame:
    l = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")  # noqa: E741
    new = l.where("l_orderkey % 10 = 0").groupBy("l_orderkey").agg(F.lit(1).alias("l_linenumber"), F.sum("l_quantity").alias("l_quantity"))
    return relational.replace_all(l, new, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def knowledge_members(spark, sf: str) -> DataFrame:
    flags = _t(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    p = _papers(spark, sf).join(flags, "doc_id", "left").withColumn("in_knowledge_base", F.coalesce("q", F.lit(0)) == 1)
    d = keyed.members(p).select("doc_id", F.explode(C.fixed_chunks(F.col("full_text"))).alias("c"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))


def access_counts(spark, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select("c_custkey", F.lit(3).cast("long").alias("access_count"))
    return keyed.counted(c, _t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], "access_count")


def parent_times(spark, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select("c_custkey", F.lit("1995-01-01").cast("timestamp").alias("updated_at"))
    o = _t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return keyed.with_parent_times(c, o, ["c_custkey"]).select("c_custkey", F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"))


def cascaded_lines(spark, sf: str) -> DataFrame:
    l, o = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber"), _t(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"))  # noqa: E741
    return keyed.with_parent(l, o, ["k"])


def translation_cache(spark, sf: str) -> DataFrame:
    d = _t(spark, sf, "conversations").select(F.lit("t").alias("tenant_id"), F.col("role").alias("user_id"), F.col("conv_id").cast("string").alias("paper_id"), F.col("text").alias("source_text"), F.lit("zh").alias("target_language"), "turn")
    known = keyed.translation_keys(d.where("turn % 2 = 0"))
    cache = known.groupBy(*keyed.TRANSLATION).agg(F.lit("old").alias("translated_text"))
    out = keyed.looked_up(d, cache, F.concat(F.lit("new:"), F.left("source_hash", F.lit(6))))
    return out.select(F.col("paper_id").alias("conv_id"), "turn", "cached", F.when(F.col("cached"), "old").otherwise(F.left("translated_text", F.lit(4))).alias("answer"))


def settings_in_force(spark, sf: str) -> DataFrame:
    n = _t(spark, sf, "nation")
    names = n.select(F.col("n_name").alias("key"), F.concat(F.lit("d"), F.col("n_regionkey").cast("string")).alias("default"))
    table, env = n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("key"), F.lit("fromtable1").alias("value")), n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("key"), F.lit("env").alias("value"))
    after = keyed.settings_after(table, n.where("n_nationkey % 6 = 0").select(F.col("n_name").alias("key"), F.lit("").alias("value")), ["CANADA"])
    return keyed.settings_in_force(names, after, env, None, ["IRAN", "CHINA"]).select("key", "origin", "shown")


def success_rates(spark, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").withColumn("bucket", F.col("user_id") % 20)
    return relational.mined_patterns(e, ["event_type", "bucket"], F.col("value") > 20, 3, 0.8)


def usage_metrics(spark, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    meta = F.to_json(F.struct(k.alias("input_tokens"), (k * 2).alias("output_tokens"), (F.col("event_id") % 3 == 0).alias("cached"), F.col("value").alias("latency_ms")))
    d = state.usage(e.withColumn("metadata", meta), ["event_type"])
    return d.withColumn("latency_p95", F.round("latency_p95", 4))


def penalty_scores(spark, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").join(_t(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")), "doc_id")
    return d.select("doc_id", citations.section_score(F.col("text"), F.col("q") == 1).alias("s")).select("doc_id", "s.score", "s.passed", F.array_join("s.findings", "; ").alias("findings"))


def token_budgets(spark, sf: str) -> DataFrame:
    c = _t(spark, sf, "conversations").withColumn("purpose", F.when(F.col("role") == "user", "conversation").when(F.col("role") == "assistant", "section").otherwise("other"))
    d = routing.with_budget(c.select("conv_id", "turn", "purpose", T.token_estimate(F.col("text"), 3).alias("tokens"), routing.budget_class(F.col("text")).alias("context_tokens")))
    return d.withColumns({x: F.col(x).cast("long") for x in ("context_tokens", "max_input_tokens", "max_output_tokens", "cache_ttl_seconds")})


def route_scores(spark, sf: str) -> DataFrame:
    c = _t(spark, sf, "conversations")
    skill = F.when(F.col("turn") == 0, "survey_review").when(F.col("turn") == 1, "citation_audit").otherwise("general_assistant")
    r = routing.route(F.col("text"), skill, F.when(F.col("turn") == 2, "cnki"), F.col("turn") == 3)
    return c.select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", "r.target", "r.execution_mode", F.col("r.score").cast("long").alias("score"), F.array_join("r.reasons", ",").alias("reasons"))


def prompt_lines(spark, sf: str) -> DataFrame:
    d = context.parted(_t(spark, sf, "conversations").withColumnRenamed("text", "content"), "conv_id", "turn", 2)
    s = context.summary(F.lit("kept line"), F.col("middle"), F.array(F.lit("search_papers")))
    return d.select("conv_id", F.size("head").cast("long").alias("n_head"), F.size("middle").cast("long").alias("n_middle"), F.size("tail").cast("long").alias("n_tail"), F.md5(s).alias("summary_md5"))


def conversation_phases(spark, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    tool = F.when(F.col("event_type") == "purchase", "acquire_paper_to_knowledge").otherwise("search_papers")
    event = F.to_json(F.struct(F.when(F.col("event_type") == "view", "user").otherwise("tool").alias("kind"), tool.alias("tool_name"), F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"), F.lit("goal").alias("content")))
    d = conversations.conversation_states(e.select("user_id", "event_id", event.alias("event")), ["user_id"], ["event_id"], fields=["phase", "last_tool"])
    return d.select("event_id", "user_id", "state_version", "phase", "last_tool")


def cache_hits(spark, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return state.cached_calls(e, ["user_id"], ["at", "event_id"], "event_type", "at", 10 * 86_400.0, 100).select("event_id", "cached")


def replayed_events(spark, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("progress").alias("event"))
    return state.replayed(e, "user_id", "event_id", "event", 100)


def task_states(spark, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "outline_required").otherwise("progress")
    e = _t(spark, sf, "events").select(F.col("user_id").alias("task_id"), "event_id", kind.alias("event"), F.col("event_type").alias("phase"), (F.col("event_id") % 90).cast("long").alias("percent"), (F.col("event_id") % 2 == 0).alias("needs_confirmation"))
    return state.task_status(e).withColumn("percent", F.col("percent").cast("long"))


def queue_states(spark, sf: str) -> DataFrame:
    action = F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "click", "reserve").when(F.col("event_type") == "purchase", "ack").when(F.col("event_type") == "error", "fail").otherwise("reserve")
    e = _t(spark, sf, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 7).cast("string")).alias("job_id"), "event_id", action.alias("action"))
    return state.queue_state(e)


def access_sessions(spark, sf: str) -> DataFrame:
    action = F.when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "click", "verifying").when(F.col("event_type") == "purchase", "verified").when(F.col("event_type") == "error", "error").otherwise("login_required")
    e = _t(spark, sf, "events").select(F.col("user_id").alias("session_id"), "event_id", action.alias("action"), F.col("ts").cast("timestamp").alias("at"))
    return state.session_status(e, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("session_id", "status")


def idle_sessions(spark, sf: str) -> DataFrame:
    d = state.idle_sessions(_t(spark, sf, "events"), "user_id", "ts", 86_400)
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return d.select("user_id", f("opened").alias("opened"), f("last_used").alias("last_used"), "n")


def dag_waves(spark, sf: str) -> DataFrame:
    p = _t(spark, sf, "part").select(F.col("p_partkey").alias("node_id"))
    deps = F.filter(F.array((F.col("node_id") / 2).cast("long"), (F.col("node_id") / 3).cast("long")), lambda x: x >= 1)
    return dag.waves(p.select(F.col("node_id").cast("long").alias("node_id"), deps.alias("depends_on"))).select("node_id", F.col("wave").cast("long").alias("wave"))


def planned_tasks(spark, sf: str) -> DataFrame:
    g = _t(spark, sf, "benchmark").select("item_id", F.when(F.col("item_id") % 4 == 0, "").otherwise(F.concat(F.lit("a survey "), "text")).alias("goal"), F.when(F.col("item_id") % 2 == 0, "APA").alias("citation_style"), (F.col("item_id") % 50).cast("int").alias("max_papers"))
    return dag.planned(g, "item_id").select("item_id", "node_id", F.array_join("depends_on", ",").alias("depends_on"), "optional")


def public_urls(spark, sf: str) -> DataFrame:
    p = _t(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("http://10.0.0.1/"), F.col("page_id").cast("string"))).when(F.col("page_id") % 7 == 0, "ftp://x.org/a").otherwise(F.col("url")).alias("url"))
    return p.select("page_id", scope.is_public_url(F.col("url")).alias("public"), scope.knowledge_url(F.col("url")).alias("kept_url"))


def text_of_index(spark, sf: str) -> DataFrame:
    from lectern.sources.stored import text_of_positions

    d = _t(spark, sf, "benchmark").select("item_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "token"))
    m = d.groupBy("item_id", "token").agg(F.sort_array(F.collect_list("pos")).alias("at")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "at"))).alias("m"))
    return m.select("item_id", text_of_positions(F.col("m")).alias("text"))


def named_parts(spark, sf: str) -> DataFrame:
    p = _t(spark, sf, "pages")
    return p.select("page_id", T.paper_id(F.lit("web"), F.col("url")).alias("paper_id"), T.safe_filename(F.col("url")).alias("file"), T.safe_name(F.col("url")).alias("short"), T.first_year(F.col("html")).alias("year"), T.masked(F.col("url")).alias("masked"))


def memory_text(spark, sf: str) -> DataFrame:
    d = _t(spark, sf, "conversations").withColumn("t", T.memory_tokens(F.col("text")))
    return d.select("conv_id", "turn", F.md5(T.normalised_memory(F.col("text"))).alias("normalised_md5"), F.size("t").cast("long").alias("n_tokens"), F.char_length(T.fitted(F.col("text"), 100)).cast("long").alias("fitted_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_table, chunk_paragraph, lexical_embedding, hash_embedding, vector_topk, bm25_postings, rag_stats, temporal_decay, memory_recall, memory_touched, citation_report, citation_format, tool_history,
        priority_union, recent_artifacts, merged_events, literature_batches, substring_search, soft_deleted_orders, deleted_orders, kept_columns, updated_columns, replaced_lines, knowledge_members,
        access_counts, parent_times, cascaded_lines, translation_cache, settings_in_force, success_rates, usage_metrics, penalty_scores, token_budgets, route_scores, prompt_lines, conversation_phases,
        cache_hits, replayed_events, task_states, queue_states, access_sessions, idle_sessions, dag_waves, planned_tasks, public_urls, text_of_index, named_parts, memory_text,
    )
}

_TOKENS = r"regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9][a-z0-9._/+\-]*')"
_CHUNKS = "list_filter(list_transform(range(0, greatest(length(t), 1), 780), lambda i: trim(substring(t, i + 1, 900))), lambda x: x <> '')"
_FLAT = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_NORMAL = r"trim(trim(regexp_replace(trim(lower(coalesce({}, ''))), '\s+', ' ', 'g')), '。；;，, ')"
_MEMORY = r"list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9][a-z0-9._/-]+'))"

ORACLE_SQL = {
    "chunk_table": f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS s, coalesce(lang, '') AS l, {_FLAT.format("'Paper ' || doc_id || chr(10) || coalesce(text, '')")} AS t FROM documents),
c AS (SELECT doc_id, s, l, unnest(x) AS content, unnest(range(len(x))) AS i FROM (SELECT *, {_CHUNKS} AS x FROM d)), k AS (SELECT *, {_TOKENS.format('content')} AS w FROM c)
SELECT sha256(concat_ws(':', s, l, doc_id, i, content)) AS chunk_id, CAST(doc_id AS VARCHAR) AS paper_id, i AS chunk_index, sha256(content) AS content_hash, CAST(len(w) AS BIGINT) AS token_count,
array_to_string(list_filter(w, lambda x, j: list_position(w, x) = j)[1:20], ' ') AS keywords FROM k""",
    "hash_embedding": """WITH d AS (SELECT item_id, sha256(coalesce(text, '')) AS h FROM benchmark), p AS (SELECT item_id, h, unnest(range(16)) AS i FROM d)
SELECT item_id, CAST(i AS INT) AS place, round((16 * (strpos('0123456789abcdef', substr(h, i * 2 + 1, 1)) - 1) + strpos('0123456789abcdef', substr(h, i * 2 + 2, 1)) - 1) / 255.0, 6) AS share FROM p""",
    "vector_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), c AS (SELECT vec_id, list_cosine_similarity(e, (SELECT e FROM v WHERE vec_id = 7)) AS c FROM v)
SELECT vec_id, row_number() OVER (ORDER BY c DESC, vec_id) AS rank, round(1 - least(1 - c, 1.0), 6) AS score FROM c ORDER BY rank LIMIT 20""",
    "rag_stats": f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS tenant_id, coalesce(lang, '') AS user_id, {_FLAT.format("coalesce(text, '')")} AS t FROM documents)
SELECT tenant_id, user_id, CAST(sum(len({_CHUNKS})) AS BIGINT) AS chunk_count, count(*) FILTER (t <> '') AS paper_count FROM d GROUP BY ALL HAVING count(*) FILTER (t <> '') > 0""",
    "temporal_decay": f"""WITH d AS (SELECT o_orderkey, greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(o_orderdate)) / 8.64e10) AS age FROM orders)
SELECT o_orderkey, round(exp(-0.6931471805599453 * age / 365.0), 6) AS half_life, round(exp(-age / 900.0), 6) AS e_fold FROM d""",
    "memory_recall": f"""WITH m AS (SELECT role, 'm' || (conv_id * 100 + turn) AS memory_id, {_MEMORY.format(_NORMAL.format('text'))} AS own, 0.5 + (turn % 5) / 10.0 AS importance, conv_id % 90 AS age FROM conversations WHERE turn <> 3),
p AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY CAST(importance AS DOUBLE) DESC, age, memory_id) AS n FROM m QUALIFY n <= 100),
q AS (SELECT {_MEMORY.format("'" + MEMORY_QUERY + "'")} AS q), o AS (SELECT p.*, len(list_intersect(own, q)) AS i, len(own) + len(q) AS u FROM p, q),
s AS (SELECT *, 0.55 * (CASE WHEN u - i = 0 THEN 0 ELSE i / CAST(u - i AS DOUBLE) END) + 0.25 * importance + 0.15 * exp(-age / 90.0) + 0.05 AS score FROM o WHERE i > 0 OR importance >= 0.82)
SELECT role AS user_id, memory_id, round(score, 6) AS score, row_number() OVER (PARTITION BY role ORDER BY score DESC, n) AS rank FROM s QUALIFY rank <= 8""",
    "memory_touched": """WITH m AS (SELECT CASE WHEN turn % 5 = 4 THEN 'forgotten' WHEN turn = 3 THEN 'forgotten' ELSE 'active' END AS status, turn % 5 = 0 AS used FROM conversations)
SELECT status, count(*) AS n, CAST(count(*) FILTER (used) AS BIGINT) AS accesses FROM m GROUP BY status""",
    "citation_report": """WITH d AS (SELECT doc_id AS doc, ['paper:' || (doc_id % 7), 'paper:' || (doc_id % 11), 'paper:' || (doc_id % 7)] AS f, list_transform(range(1, doc_id % 9 + 1), lambda i: 'paper:' || i) AS p FROM documents),
x AS (SELECT *, list_filter(f, lambda r: NOT list_contains(p, r)) AS h, list_filter(p, lambda r: NOT list_contains(f, r)) AS m FROM d)
SELECT doc, array_to_string(f, ',') AS found_ids, array_to_string(h, ',') AS hallucinated_ids, array_to_string(list_sort(m), ',') AS missing_reference_ids,
CASE WHEN len(p) = 0 THEN 0.0 ELSE round((len(p) - len(m)) / CAST(len(p) AS DOUBLE), 4) END AS coverage, len(h) = 0 AS is_valid FROM x""",
    "citation_format": """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN c_name || ', "' || o_orderpriority || '," ' || o_orderstatus || ', ' || y || '.' WHEN 1 THEN c_name || ' (' || y || '). ' || o_orderpriority || '. ' || o_orderstatus || '.'
ELSE c_name || '. ' || o_orderpriority || '[J]. ' || o_orderstatus || ', ' || y || '.' END AS reference FROM (SELECT *, strftime(o_orderdate, '%Y') AS y FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "tool_history": "SELECT c_custkey, c_custkey IN (SELECT user_id FROM events WHERE event_type = 'error') AS failed_once FROM customer",
    "priority_union": """WITH s AS (SELECT * FROM (SELECT 0 AS p, doc_id, lang FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 5) UNION ALL SELECT * FROM (SELECT 1, doc_id, lang FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 4)
UNION ALL SELECT * FROM (SELECT 2, doc_id, lang FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 50)) SELECT doc_id, lang FROM s ORDER BY p, doc_id LIMIT 20""",
    "recent_artifacts": """WITH d AS (SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY ALL)
SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 2""",
    "merged_events": """WITH e AS (SELECT user_id, event_id AS p, event_id % 3 AS o, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'c' || (event_id % 4) END AS call_id, event_type AS status FROM events),
k AS (SELECT *, CASE WHEN o = 2 OR call_id = '' THEN '#' || o || ':' || p ELSE call_id END AS k FROM e),
g AS (SELECT user_id, k, min(o * 1000000000 + p) AS f, max_by(call_id, o * 1000000000 + p) AS call_id, max_by(status, o * 1000000000 + p) AS status FROM k GROUP BY ALL)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY f) AS place, call_id, status FROM g""",
    "literature_batches": """WITH RECURSIVE d AS (SELECT source, coalesce(lang, '') AS lang, doc_id, greatest(1, length(coalesce(text, '')) // 4) AS t, row_number() OVER (PARTITION BY source, coalesce(lang, '') ORDER BY doc_id) AS n FROM documents),
r AS (SELECT source, lang, doc_id, n, t AS used, CAST(0 AS BIGINT) AS batch FROM d WHERE n = 1
UNION ALL SELECT d.source, d.lang, d.doc_id, d.n, CASE WHEN r.used + d.t > 4000 THEN d.t ELSE r.used + d.t END, CASE WHEN r.used + d.t > 4000 THEN r.batch + 1 ELSE r.batch END
FROM r JOIN d ON d.source IS NOT DISTINCT FROM r.source AND d.lang = r.lang AND d.n = r.n + 1)
SELECT source, lang, batch, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY n) AS ids FROM r GROUP BY ALL""",
    "substring_search": "SELECT doc_id, source FROM documents WHERE lang = 'en' AND contains(lower(text), 'hation') ORDER BY doc_id DESC LIMIT 25",
    "soft_deleted_orders": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'forgotten' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    "deleted_orders": "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderstatus IN ('F', 'O'))",
    "kept_columns": """SELECT c_custkey, CASE WHEN c_custkey % 8 = 4 THEN 'new' ELSE c_name END AS c_name, c_acctbal FROM customer
UNION ALL SELECT c_custkey + 1000000, 'new', -1.0 FROM customer WHERE c_custkey % 8 = 0""",
    "updated_columns": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 6 = 0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "replaced_lines": "SELECT l_orderkey, CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE count(*) END AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_orderkey",
    "knowledge_members": f"""WITH d AS (SELECT doc_id, {_FLAT.format("coalesce(text, '')")} AS t FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT doc_id, CAST(len({_CHUNKS}) AS BIGINT) AS n_chunks FROM d WHERE t <> ''""",
    "access_counts": "SELECT c_custkey, CAST(CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 4 ELSE 3 END AS BIGINT) AS access_count FROM customer",
    "parent_times": "SELECT c_custkey, strftime(greatest(TIMESTAMP '1995-01-01', coalesce(m, TIMESTAMP '1995-01-01')), '%Y-%m-%d') AS updated_on FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "cascaded_lines": "SELECT l_orderkey AS k, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')",
    "translation_cache": f"""WITH d AS (SELECT conv_id, turn, role, {_FLAT.format("coalesce(text, '')")} AS t FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn, EXISTS (SELECT 1 FROM d k WHERE k.turn % 2 = 0 AND k.conv_id = d.conv_id AND k.role = d.role AND k.t = d.t) AS cached,
CASE WHEN EXISTS (SELECT 1 FROM d k WHERE k.turn % 2 = 0 AND k.conv_id = d.conv_id AND k.role = d.role AND k.t = d.t) THEN 'old' ELSE 'new:' END AS answer FROM d""",
    "settings_in_force": """WITH s AS (SELECT n_name AS key, n_regionkey AS r, n_nationkey % 3 = 0 AND (n_nationkey % 6 <> 0 OR n_name = 'CANADA') AS t, n_nationkey % 2 = 0 AS e, n_name IN ('IRAN', 'CHINA') AS secret FROM nation),
v AS (SELECT *, CASE WHEN t THEN 'fromtable1' WHEN e THEN 'env' ELSE 'd' || r END AS value FROM s)
SELECT key, CASE WHEN t THEN 'table' WHEN e THEN 'environment' ELSE 'default' END AS origin, CASE WHEN NOT secret THEN value WHEN length(value) <= 8 THEN '********' ELSE left(value, 4) || '...' || right(value, 4) END AS shown FROM v""",
    "success_rates": """SELECT event_type, user_id % 20 AS bucket, count(*) FILTER (value > 20) AS successes, count(*) FILTER (NOT value > 20) AS failures, round(count(*) FILTER (value > 20) / (count(*) FILTER (value > 20) + count(*) FILTER (NOT value > 20)), 4) AS success_rate
FROM events GROUP BY ALL HAVING successes >= 3 AND success_rate >= 0.8""",
    "usage_metrics": """WITH e AS (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 3 = 0 AS c, value FROM events)
SELECT event_type, count(*) AS calls, CAST(sum(k) AS BIGINT) AS input_tokens, CAST(sum(k * 2) AS BIGINT) AS output_tokens, round(avg(CAST(c AS DOUBLE)), 4) AS cache_rate, round(quantile_cont(value, 0.95), 4) AS latency_p95 FROM e GROUP BY event_type""",
    "penalty_scores": """WITH d AS (SELECT doc_id, coalesce(q, 0) <> 1 AS bad, length(coalesce(text, '')) < 120 AS short FROM documents JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) USING (doc_id))
SELECT doc_id, CAST(90 - CASE WHEN bad THEN 35 ELSE 0 END - CASE WHEN short THEN 10 ELSE 0 END AS INT) AS score, NOT bad AND NOT short AS passed,
array_to_string(list_filter([CASE WHEN bad THEN 'section contains unsupported citation ids' END, CASE WHEN short THEN 'section is too short' END], lambda x: x IS NOT NULL), '; ') AS findings FROM d""",
    "token_budgets": """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'conversation' WHEN 'assistant' THEN 'section' ELSE 'other' END AS purpose, greatest(1, length(coalesce(text, '')) // 3) AS tokens, CAST(CASE WHEN length(text) > 280 THEN 7000 ELSE 2600 END AS BIGINT) AS context_tokens,
CAST(CASE role WHEN 'user' THEN 5600 WHEN 'assistant' THEN 6000 ELSE 5000 END AS BIGINT) AS max_input_tokens, CAST(CASE role WHEN 'user' THEN 1000 WHEN 'assistant' THEN 1200 ELSE 1000 END AS BIGINT) AS max_output_tokens, CAST(CASE role WHEN 'assistant' THEN 3600 ELSE 0 END AS BIGINT) AS cache_ttl_seconds FROM conversations""",
    "route_scores": """WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations), f AS (SELECT *, length(t) > 180 AS a, length(t) - length(replace(t, chr(10), '')) >= 4 AS b, regexp_matches(t, '1[.、]|2[.、]') AS d FROM c),
s AS (SELECT *, 2 * a::INT + 2 * b::INT + d::INT AS score FROM f)
SELECT conv_id, turn, CASE turn WHEN 0 THEN 'writing_agent' WHEN 1 THEN 'citation_agent' ELSE 'general_orchestrator' END AS target, CASE WHEN score >= 4 OR (turn <= 1 AND score >= 2) THEN 'delegation' WHEN turn <= 1 THEN 'skill' ELSE 'direct' END AS execution_mode, CAST(score AS BIGINT) AS score,
array_to_string(list_filter([CASE WHEN a THEN 'long_request' END, CASE WHEN b THEN 'multi_constraint' END, CASE WHEN d THEN 'explicit_steps' END, CASE turn WHEN 0 THEN 'writing_intent' WHEN 1 THEN 'citation_audit_intent' ELSE 'general_intent' END,
CASE WHEN turn = 2 THEN 'active_source:cnki' END, CASE WHEN turn = 3 THEN 'pending_action_present' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s""",
    "prompt_lines": f"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
p AS (SELECT *, CASE WHEN i > n - least(2, n) THEN 'tail' WHEN i <= 2 THEN 'head' ELSE 'middle' END AS part FROM c),
m AS (SELECT conv_id, '- ' || CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || '：' || left({_FLAT.format('t')}, 240) AS line, min(i) AS i FROM p WHERE part = 'middle' AND {_FLAT.format('t')} <> '' GROUP BY ALL),
l AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY i) AS lines FROM m GROUP BY conv_id),
g AS (SELECT conv_id, count(*) FILTER (part = 'head') AS n_head, count(*) FILTER (part = 'middle') AS n_middle, count(*) FILTER (part = 'tail') AS n_tail FROM p GROUP BY conv_id)
SELECT conv_id, n_head, n_middle, n_tail, md5(right('kept line' || chr(10) || coalesce(lines || chr(10), '') || '- 已执行工具：search_papers', 5000)) AS summary_md5 FROM g LEFT JOIN l USING (conv_id)""",
    "conversation_phases": """WITH e AS (SELECT *, event_type NOT IN ('view', 'error') AS won, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS state_version FROM events)
SELECT event_id, user_id, state_version, CASE WHEN event_type = 'view' THEN 'planning' WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error' THEN 'search_failed' ELSE 'selection_ready' END AS phase,
coalesce(last_value(CASE WHEN won THEN CASE WHEN event_type = 'purchase' THEN 'acquire_paper_to_knowledge' ELSE 'search_papers' END END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), '') AS last_tool FROM e""",
    "cache_hits": """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT event_id, user_id, event_type, n, false AS cached, ts AS stored FROM e WHERE n = 1
UNION ALL SELECT e.event_id, e.user_id, e.event_type, e.n, e.ts <= r.stored + INTERVAL 10 DAYS, CASE WHEN e.ts <= r.stored + INTERVAL 10 DAYS THEN r.stored ELSE e.ts END
FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.n = r.n + 1) SELECT event_id, cached FROM r""",
    "replayed_events": """WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'progress' END AS event FROM events), t AS (SELECT user_id, min(event_id) AS x FROM e WHERE event <> 'progress' GROUP BY 1)
SELECT user_id, event_id, event FROM e LEFT JOIN t USING (user_id) WHERE event_id > 100 AND (x IS NULL OR event_id <= x)""",
    "task_states": """WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT user_id AS task_id, CASE WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'waiting_user' ELSE 'running' END AS status,
CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE event_type END AS phase, CAST(CASE WHEN event_type = 'purchase' THEN 100 ELSE event_id % 90 END AS BIGINT) AS percent FROM l""",
    "queue_states": """WITH e AS (SELECT user_id || '-' || event_id % 7 AS user_id, event_id, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'purchase' THEN 'ack' WHEN 'error' THEN 'fail' ELSE 'reserve' END AS a FROM events),
g AS (SELECT user_id, max_by(a, event_id) AS last, count(*) FILTER (a = 'reserve') AS attempt, bool_or(a = 'ack') AS acked FROM e GROUP BY user_id)
SELECT user_id AS job_id, CASE WHEN acked THEN 'done' WHEN last = 'fail' AND attempt >= 3 THEN 'dead' WHEN last = 'reserve' THEN 'unacknowledged' ELSE 'waiting' END AS status, attempt FROM g""",
    "access_sessions": """WITH g AS (SELECT user_id, max_by(event_type, event_id) AS last, max_by(ts, event_id) FILTER (event_type = 'purchase') AS v FROM events GROUP BY user_id)
SELECT user_id AS session_id, CASE last WHEN 'signup' THEN 'awaiting_user_login' WHEN 'click' THEN 'verifying' WHEN 'error' THEN 'error' WHEN 'purchase' THEN CASE WHEN v + INTERVAL 8 HOURS <= TIMESTAMP '2024-01-20' THEN 'expired' ELSE 'active' END ELSE 'awaiting_user_login' END AS status FROM g""",
    "idle_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS opened, strftime(max(ts), '%Y-%m-%d %H:%M') AS last_used, count(*) AS n FROM s GROUP BY user_id, s""",
    "dag_waves": """WITH RECURSIVE r AS (SELECT CAST(p_partkey AS BIGINT) AS node_id, CAST(0 AS BIGINT) AS wave FROM part UNION SELECT p_partkey, r.wave + 1 FROM r JOIN part ON r.node_id >= 1 AND (r.node_id = p_partkey // 2 OR r.node_id = p_partkey // 3))
SELECT node_id, max(wave) AS wave FROM r GROUP BY node_id""",
    "planned_tasks": """WITH g AS (SELECT item_id, item_id % 50 >= 30 OR length('a survey ' || text) >= 180 AS c FROM benchmark WHERE item_id % 4 <> 0 AND text IS NOT NULL)
SELECT item_id, 'research_scope' AS node_id, '' AS depends_on, false AS optional FROM g UNION ALL SELECT item_id, 'argument_structure', 'research_scope', false FROM g UNION ALL SELECT item_id, 'citation_policy', 'research_scope', false FROM g
UNION ALL SELECT item_id, 'preflight_critic', 'research_scope,argument_structure,citation_policy', true FROM g WHERE c""",
    "public_urls": """WITH p AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'http://10.0.0.1/' || page_id WHEN page_id % 7 = 0 THEN 'ftp://x.org/a' ELSE url END AS url FROM pages)
SELECT page_id, coalesce(regexp_matches(url, '^https?://') AND page_id % 5 <> 0, false) AS public, CASE WHEN contains(lower(url), '.caj') THEN '' ELSE trim(coalesce(url, '')) END AS kept_url FROM p""",
    "text_of_index": f"SELECT item_id, array_to_string({_TOKENS.format('text')}, ' ') AS text FROM benchmark WHERE len({_TOKENS.format('text')}) > 0",
    "named_parts": r"""WITH s AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h, url FROM pages)
SELECT page_id, 'paper:web:' || translate(trim(url), '/: ', '___') AS paper_id, CASE WHEN trim(u) = '' THEN 'paper.pdf' ELSE regexp_replace(trim(u), '[^\pL\pN._-]', '_', 'g') END AS file,
CASE WHEN trim(regexp_replace(u, '[^A-Za-z0-9._-]+', '_', 'g'), '._') = '' THEN 'institution_document' ELSE left(trim(regexp_replace(u, '[^A-Za-z0-9._-]+', '_', 'g'), '._'), 120) END AS short,
regexp_extract(h, '(?:19|20)\d{2}') AS year, CASE WHEN u = '' THEN '' WHEN length(u) <= 8 THEN '********' ELSE left(u, 4) || '...' || right(u, 4) END AS masked FROM s""",
    "memory_text": f"""SELECT conv_id, turn, md5({_NORMAL.format('text')}) AS normalised_md5, CAST(len({_MEMORY.format('text')}) AS BIGINT) AS n_tokens,
CAST(CASE WHEN length(text) <= 300 THEN length(text) ELSE 100 + length(chr(10) || chr(10) || '[中间上下文已按预算压缩]' || chr(10) || chr(10)) + 158 END AS BIGINT) AS fitted_chars FROM conversations""",
}

#: The same ranking as from whole texts.
SAME_AS = {"bm25_postings": "bm25_search"}
