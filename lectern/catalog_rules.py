"""Queries of rules on single rows and of records: memories, pieces of texts, ids, maps, audits, runs, listings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import citations, collections, memory, records, scope
from lectern.plans import routing
from lectern.streaming import state


def _t(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def memory_extraction(spark, sf: str) -> DataFrame:
    """What users ask to be remembered, in messages made of what they said."""
    d = _t(spark, sf, "conversations").where("text IS NOT NULL")
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("请记住："), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("我喜欢"), "text", F.lit("。以后请用 IEEE"))).otherwise(F.col("text"))
    d = d.select(F.lit("t").alias("tenant_id"), F.lit("u").alias("user_id"), F.col("conv_id").alias("conversation_id"), F.col("turn").alias("position"), "role", said.alias("content"))
    m = memory.extracted(d)
    return m.select(F.col("conversation_id").alias("conv_id"), F.col("position").cast("long").alias("turn"), F.col("rule").cast("long").alias("rule"), "memory_type", "importance", F.md5("content").alias("content_md5"), F.md5("normalized_content").alias("normalized_md5"), "memory_id")


def text_pieces(spark, sf: str) -> DataFrame:
    """Sentences, paragraphs and the fitted form of every document."""
    d = _t(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "n_chars")
    return d.select(
        "doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"), F.md5(F.array_join(T.sentences(F.col("text")), "|")).alias("sentences_md5"), F.size(T.paragraphs(F.col("text"))).cast("long").alias("n_paragraphs"),
        F.md5(T.fitted(F.col("text"), 200)).alias("fitted_md5"), T.clamped(F.col("n_chars"), 100, 5000).cast("long").alias("clamped"),
    )


def found_ids(spark, sf: str) -> DataFrame:
    """Ids, links and predicates of every page's address."""
    p = _t(spark, sf, "pages").withColumn("said", F.concat(F.lit("see "), "url", F.lit("。 or paper:web:"), F.col("page_id").cast("string"), F.lit("-x, ok")))
    number = F.concat(F.lit("arXiv:23"), F.lpad((F.col("page_id") % 100).cast("string"), 2, "0"), F.lit("."), F.lpad((F.col("page_id") % 99991).cast("string"), 5, "0"), F.when(F.col("page_id") % 2 == 0, "v1").otherwise("w"))
    return p.select(
        "page_id", T.first_paper_id(F.col("said")).alias("paper_id"), T.first_link(F.col("said")).alias("link"), T.arxiv_id(number).alias("arxiv"), T.is_arxiv_id(number).alias("is_arxiv"),
        scope.inside(F.concat(F.lit("/data/"), F.regexp_replace("url", "^https?://", "")), F.lit("/data/./x/../ththre.example.com")).alias("inside"),
        scope.full_text_available(F.when(F.col("page_id") % 3 == 0, "arxiv"), F.lit(None).cast("string"), F.col("page_id") % 2 == 0, F.when(F.col("page_id") % 5 > 0, F.col("url"))).alias("full_text"),
    )


def record_maps(spark, sf: str) -> DataFrame:
    """JSON of events as maps: decoded with a fallback, laid over each other, cut to a list of fields, without blanks, redacted."""
    e = _t(spark, sf, "events")
    text = F.when(F.col("event_id") % 10 == 0, "no json").otherwise(F.col("props"))
    own = records.decoded(text, "map<string,string>", F.create_map(F.lit("k"), F.lit("none")))
    more = F.create_map(F.lit("k"), F.when(F.col("event_id") % 3 == 0, F.lit("over")), F.lit("type"), F.col("event_type"), F.lit("blank"), F.lit(""), F.lit("api_key"), F.lit("s"))
    flat = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda x: F.concat_ws("=", x["key"], F.coalesce(x["value"], F.lit("null"))))), ",")
    d = e.select("event_id", F.when(F.col("event_id") % 3 == 0, records.overlaid(own, more)).otherwise(records.overlaid(more, own)).alias("m"), text.alias("t"))
    return d.select(
        "event_id", flat(F.col("m")).alias("overlaid"), flat(records.only(F.col("m"), ["k", "type"])).alias("only_two"), flat(records.pruned(F.col("m"))).alias("pruned"),
        flat(scope.redacted_map(F.col("m"))).alias("redacted"), records.navigated(F.when(F.col("t") != "no json", F.col("t")), "$.k", "missing").alias("k"),
    )


def task_audits(spark, sf: str) -> DataFrame:
    """The audit that each finished task's result holds."""
    d = _t(spark, sf, "orders")
    ids = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 4 + 1).cast("int")), lambda i: F.concat(F.lit('"p'), i.cast("string"), F.lit('"'))), ","), F.lit("]"))
    result = F.format_string('{"citation_audit": {"is_valid": %s, "coverage": 0.%d, "hallucinated_ids": %s}}', F.when(F.col("o_orderkey") % 2 == 0, "true").otherwise("false"), F.col("o_orderkey") % 10, ids)
    tasks = d.select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 5 > 0, result).alias("result_json"))
    return records.task_audit(tasks).withColumn("n_hallucinated", F.col("n_hallucinated").cast("long"))


def run_tree(spark, sf: str) -> DataFrame:
    """Agent runs as they stand, with depth, and their children."""
    e = _t(spark, sf, "events")
    ledger = e.select((F.col("event_id") % 997).alias("run_id"), F.when(F.col("event_id") % 997 >= 100, (F.col("event_id") % 997 % 100).cast("string")).alias("parent_run_id"), F.col("event_type").alias("status"), "event_id")
    r = records.runs(ledger).withColumn("run_id", F.col("run_id").cast("string"))
    return records.children(r).select("run_id", "child_run_id", "child_status").join(r.select("run_id", "status", F.col("depth").cast("long").alias("depth")), "run_id")


def event_notes(spark, sf: str) -> DataFrame:
    """Kind and level of each event's trace, its id, its latency and whether its task may be deleted."""
    e = _t(spark, sf, "events")
    kind = F.when(F.col("event_type") == "view", "retrieval").when(F.col("event_type") == "click", "tool_call").when(F.col("event_type") == "purchase", "model_call").otherwise(F.col("event_type"))
    started, seen = F.col("ts").cast("timestamp"), state.observation(kind)
    ended = F.timestamp_micros(F.unix_micros(started) + F.round(F.col("value") * 1000).cast("long") - 5000)
    return e.select(
        "event_id", seen["kind"].alias("kind"), seen["level"].alias("level"), records.event_id(F.col("user_id"), F.col("event_id")).alias("key"), records.latency_ms(started, ended).alias("latency_ms"),
        state.can_delete(F.when(F.col("event_type") == "purchase", "completed").otherwise("running")).alias("can_delete"), F.sha2(state.frames(F.col("event_type"), F.col("props")), 256).alias("frame_sha256"),
    )


def event_tally(spark, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    return records.tally(e, failed=F.col("event_type") == "error", large=F.col("value") > 50, none=F.col("value").isNull())


def last_errors(spark, sf: str) -> DataFrame:
    return records.last_matching(_t(spark, sf, "events"), ["user_id"], "event_id", F.col("event_type") == "error", ["event_id", "value"])


def order_listing(spark, sf: str) -> DataFrame:
    """The newest urgent or high orders: a page of a list, over a short list of values."""
    d = scope.among(_t(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])
    return scope.listing(records.with_prefix(d, "o_orderpriority", "1-"), [F.desc("o_orderdate"), F.col("o_orderkey")], 500).select("o_orderkey", "o_orderpriority")


def chosen_results(spark, sf: str) -> DataFrame:
    """Places that users name, and what stands there in their list."""
    c = _t(spark, sf, "conversations").where("role = 'user'")
    said = F.concat(F.lit("下载第"), (F.col("conv_id") % 7 + 1).cast("string"), F.lit("篇和第"), F.element_at(F.array(F.lit("一"), F.lit("三"), F.lit("九")), (F.col("turn") % 3 + 1).cast("int")), F.lit("篇"))
    picks = c.select("conv_id", "turn", collections.chosen_places(said).alias("places")).select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("list"), "places")
    results = c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("list"), F.posexplode(F.slice(T.tokens(F.col("text")), 1, 5)).alias("i", "title")).select("list", (F.col("i") + 1).alias("place"), "title")
    return collections.at_place(picks, results, "list").select("list", F.col("place").cast("long").alias("place"), "title", "found")


def numbered_references(spark, sf: str) -> DataFrame:
    """References of each customer's orders, numbered, and which customers are cited by an urgent order."""
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    d = citations.numbered_references(o, "o_custkey", "o_orderkey", "o_orderstatus")
    return d.select("o_custkey", "o_orderkey", F.col("number").cast("long").alias("number"), "line")


def planned_tools(spark, sf: str) -> DataFrame:
    """The tool and the arguments that rules choose for a request made of each turn, and the plan of search and download."""
    c = _t(spark, sf, "conversations").select("conv_id", "turn", ((F.col("conv_id") + F.col("turn")) % 10).alias("i"), F.concat(F.lit("alpha"), F.translate(F.col("conv_id").cast("string"), "0123456789", "abcdefghij")).alias("w"))
    said = {
        0: F.lit("连接机构"), 1: F.concat(F.lit("在知网搜索"), "w", F.lit("论文")), 2: F.lit("下载这篇"), 3: F.lit("保存这篇"), 4: F.concat(F.lit("删除 paper:web:"), F.col("conv_id").cast("string")), 5: F.lit("知识库有哪些"),
        6: F.concat(F.lit("下载 https://direct.mit.edu/"), "w"), 7: F.concat(F.lit("搜索"), "w", F.lit("文献")), 8: F.concat(F.lit("在知网搜索"), "w", F.lit("并下载第2篇")), 9: F.lit("天气如何"),
    }
    content = F.lit(None).cast("string")
    for i, x in said.items():
        content = F.when(F.col("i") == i, x).otherwise(content)
    none, chosen = F.lit(None).cast("string"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("paper:a:"), F.col("conv_id").cast("string")))
    c = c.withColumns({"p": routing.deterministic_plan(content, none, F.lit(False), chosen), "b": routing.combined_plan(content, F.lit(False))})
    flat = F.array_join(F.array_sort(F.transform(F.map_entries("p.arguments"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return c.select("conv_id", "turn", "p.tool_name", flat.alias("arguments"), F.col("b.query").alias("both_query"), F.array_join("b.places", ",").alias("both_places"))


QUERIES = {f.__name__: f for f in (
    memory_extraction, text_pieces, found_ids, record_maps, task_audits, run_tree, event_notes, event_tally, last_errors, order_listing, chosen_results, numbered_references, planned_tools,
)}

_FLAT = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_NORMAL = r"trim(trim(regexp_replace(trim(lower({})), '\s+', ' ', 'g')), '。；;，, ')"
_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9._/+\-]*')"
_RULES = ", ".join(f"(CASE WHEN regexp_matches(x, '{p}') THEN {{'k': '{k}', 'c': left(regexp_extract(x, '{p}', {g}), 500), 'i': CAST({w} AS DOUBLE)}} END)" for k, p, w, g in memory.RULES)
_SPLIT = "list_filter(list_transform(string_split_regex(coalesce(text, ''), '{}'), lambda x: trim(x)), lambda x: x <> '')"
_JOINED = "list_aggregate(list_sort(list_transform(list_filter({0}, lambda x: {1}), lambda x: x.key || '=' || {2})), 'string_agg', ',')"

ORACLE_SQL = {
    "memory_extraction": f"""WITH c AS (SELECT conv_id, turn, role, CASE turn % 3 WHEN 0 THEN '请记住：' || text WHEN 1 THEN '我喜欢' || text || '。以后请用 IEEE' ELSE text END AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE text IS NOT NULL),
u AS (SELECT conv_id, turn, left({_FLAT.format("t")}, 1200) AS x FROM c WHERE n <= 6 AND role = 'user'),
f AS (SELECT conv_id, turn, list_slice(list_filter([{_RULES}], lambda r: r IS NOT NULL), 1, 3) AS found FROM u),
e AS (SELECT conv_id, turn, unnest(range(0, len(found))) AS rule, unnest(found) AS r FROM f),
m AS (SELECT conv_id, turn, rule, r.k AS memory_type, r.i AS importance, trim(r.c) AS content, {_NORMAL.format("r.c")} AS normal FROM e)
SELECT conv_id, CAST(turn AS BIGINT) AS turn, rule, memory_type, importance, md5(content) AS content_md5, md5(normal) AS normalized_md5, 'mem_' || left(sha256('t|u|' || memory_type || '|' || normal), 32) AS memory_id FROM m WHERE length(normal) >= 3""",
    "text_pieces": f"""SELECT doc_id, CAST(len({_SPLIT.format("[。！？.!?]")}) AS BIGINT) AS n_sentences, md5(array_to_string({_SPLIT.format("[。！？.!?]")}, '|')) AS sentences_md5,
CAST(len(list_filter(list_transform(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS BIGINT) AS n_paragraphs,
md5(CASE WHEN length(coalesce(text, '')) <= 600 THEN coalesce(text, '') ELSE left(text, 200) || chr(10) || chr(10) || '[中间上下文已按预算压缩]' || chr(10) || chr(10) || right(text, 358) END) AS fitted_md5, CAST(least(greatest(n_chars, 100), 5000) AS BIGINT) AS clamped FROM documents""",
    "found_ids": r"""WITH p AS (SELECT page_id, url, '23' || lpad(CAST(page_id % 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST(page_id % 99991 AS VARCHAR), 5, '0') || CASE WHEN page_id % 2 = 0 THEN 'v1' ELSE 'w' END AS a FROM pages)
SELECT page_id, 'paper:web:' || page_id || '-x' AS paper_id, rtrim(regexp_extract('see ' || url || '。 or', 'https?://[^\s<>\]\["'']+'), '。；，,)）') AS link, a AS arxiv, page_id % 2 = 0 AS is_arxiv,
regexp_replace(url, '^https?://', '') = 'ththre.example.com' OR regexp_matches(url, '^https?://ththre\.example\.com/') AS inside, page_id % 3 = 0 OR (page_id % 2 = 0 AND page_id % 5 > 0) AS full_text FROM p""",
    "record_maps": f"""WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 10 = 0 THEN 'none' ELSE json_extract_string(props, '$.k') END AS k FROM events),
m AS (SELECT event_id, k, CASE WHEN event_id % 3 = 0 THEN 'over' ELSE k END AS kk, event_type FROM e),
l AS (SELECT event_id, k, [{{'key': 'k', 'value': kk}}, {{'key': 'type', 'value': event_type}}, {{'key': 'blank', 'value': ''}}, {{'key': 'api_key', 'value': 's'}}] AS m FROM m)
SELECT event_id, {_JOINED.format("m", "true", "x.value")} AS overlaid, {_JOINED.format("m", "x.key IN ('k', 'type')", "x.value")} AS only_two, {_JOINED.format("m", "x.value <> ''", "x.value")} AS pruned,
{_JOINED.format("m", "true", "CASE WHEN x.key = 'api_key' THEN '[REDACTED]' ELSE x.value END")} AS redacted, CASE WHEN event_id % 10 = 0 THEN 'missing' ELSE k END AS k FROM l""",
    "task_audits": """SELECT o_orderkey AS task_id, o_orderstatus AS status, o_orderkey % 5 > 0 AND o_orderkey % 2 = 0 AS is_valid, CASE WHEN o_orderkey % 5 > 0 THEN CAST('0.' || (o_orderkey % 10) AS DOUBLE) ELSE 0 END AS coverage,
CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 4 + 1 ELSE 0 END AS n_hallucinated FROM orders""",
    "run_tree": """WITH r AS (SELECT event_id % 997 AS run, max_by(event_type, event_id) AS status FROM events GROUP BY 1)
SELECT CAST(p.run AS VARCHAR) AS run_id, CAST(c.run AS VARCHAR) AS child_run_id, c.status AS child_status, p.status, CAST(0 AS BIGINT) AS depth FROM r p LEFT JOIN r c ON c.run >= 100 AND c.run % 100 = p.run WHERE p.run < 100""",
    "event_notes": """SELECT event_id, CASE event_type WHEN 'view' THEN 'retriever' WHEN 'click' THEN 'tool' WHEN 'purchase' THEN 'generation' ELSE 'span' END AS kind, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'DEFAULT' END AS level,
'evt_' || left(sha256(user_id || '|' || event_id), 32) AS key, CAST(greatest(0, round((round(value * 1000) - 5000) / 1000)) AS BIGINT) AS latency_ms, event_type = 'purchase' AS can_delete,
sha256('event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10)) AS frame_sha256 FROM events""",
    "planned_tools": """WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 10 AS i, 'alpha' || translate(CAST(conv_id AS VARCHAR), '0123456789', 'abcdefghij') AS w, CASE WHEN turn % 2 = 0 THEN 'paper:a:' || conv_id END AS p FROM conversations)
SELECT conv_id, turn, CASE i WHEN 0 THEN 'start_institution_login' WHEN 1 THEN 'search_cnki_papers' WHEN 2 THEN CASE WHEN p IS NULL THEN 'institution_session_status' ELSE 'acquire_paper_to_knowledge' END
WHEN 3 THEN CASE WHEN p IS NULL THEN 'search_papers' ELSE 'acquire_paper_to_knowledge' END WHEN 4 THEN 'delete_knowledge' WHEN 5 THEN 'search_papers' WHEN 6 THEN 'download_institution_url' WHEN 7 THEN 'search_papers' WHEN 8 THEN 'search_cnki_papers' END AS tool_name,
CASE i WHEN 0 THEN '' WHEN 1 THEN 'limit=20,query=' || w WHEN 2 THEN coalesce('paper_id=' || p, '') WHEN 3 THEN coalesce('paper_id=' || p, 'limit=5,query=这篇,source=all') WHEN 4 THEN 'paper_id=paper:web:' || conv_id WHEN 5 THEN 'limit=10,query=,source=local'
WHEN 6 THEN 'source=mit_press,source_url=https://direct.mit.edu/' || w WHEN 7 THEN 'limit=5,query=' || w || ',source=all' WHEN 8 THEN 'limit=20,query=' || w END AS arguments,
CASE i WHEN 8 THEN w END AS both_query, CASE i WHEN 8 THEN '2' END AS both_places FROM c""",
    "event_tally": "SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (value > 50) AS large, count(*) FILTER (value IS NULL) AS none FROM events",
    "last_errors": "SELECT user_id, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events WHERE event_type = 'error' GROUP BY user_id",
    "order_listing": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 200",
    "chosen_results": f"""WITH c AS (SELECT conv_id || '-' || turn AS list, list_sort(list_distinct([conv_id % 7 + 1, CASE turn % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 9 END])) AS places, list_slice({_TOKENS}, 1, 5) AS t FROM conversations WHERE role = 'user'),
p AS (SELECT list, unnest(places) AS place, t FROM c) SELECT list, CAST(place AS BIGINT) AS place, t[place] AS title, place <= len(t) AS found FROM p""",
    "numbered_references": "SELECT o_custkey, o_orderkey, row_number() OVER w AS number, (row_number() OVER w) || '. ' || o_orderstatus AS line FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
}
