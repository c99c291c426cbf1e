"""Requests as columns: which agent and how, which command, how many tokens, and whether a plan may run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import collapsed, first_link, first_paper_id, once
from lectern.operators.collections import chosen_places

# The words that tell what a request is about.
WRITING = ("写作", "论文", "综述", "报告", "章节", "大纲", "参考文献", "改写", "续写")
AUDIT = ("引用审计", "引用核验", "虚构引用", "引用覆盖", "可追溯")
RETRIEVAL = ("检索", "搜索", "查找", "知识库", "文献", "论文")
COMPLEX = ("对比", "分析", "规划", "系统", "完整", "多角度", "分别", "评估", "方案", "端到端")
SEPARATORS = ("，", "；", "\n", "并且", "然后")
# The words that tell how much context a request needs.
RECALL_PHRASES = ("刚才做了什么", "刚刚做了什么", "前面做了什么", "做过什么操作", "刚才进行了什么", "回顾刚才", "总结刚才", "之前做了什么")
ACTION_PHRASES = ("搜索", "检索", "查询", "下载", "保存", "入库", "删除", "知识库", "知网", "生成", "写作")
COMPLEX_PHRASES = ("完整", "系统", "分步骤", "多角度", "对比", "分析", "规划", "分别", "端到端")
# Tokens of input and output, and seconds in the cache, by purpose.
BUDGETS = {
    "intent_planning": (1800, 420, 300), "tool_planning": (1800, 420, 300), "conversation": (5600, 1000, 0), "orchestrator_synthesis": (7000, 1200, 0), "delegated_agent": (4200, 800, 0),
    "outline": (5200, 900, 1800), "section": (6000, 1200, 3600), "critic": (3600, 600, 1800), "translation": (4200, 1400, 0), "connection_probe": (1200, 200, 60),
}
DEFAULT_BUDGET = (5000, 1000, 0)
# Commands that need no plan.
COMMANDS = {
    "institution_session_status": ("查看机构访问状态", "机构访问状态", "机构会话状态", "学校vpn状态"), "start_institution_login": ("连接机构", "启动机构登录", "连接学校", "机构登录"),
    "confirm_institution_browser_login": ("登录完成", "已经登录", "已完成登录", "我登录好了"), "search_papers": ("查看知识库有什么论文", "知识库有什么论文", "看看知识库", "查看知识库"),
}
# Patterns of refused downloads, of topics and their edges, and the words that queries lose.
REFUSED = "(?:不要|不用|无需|不需要|先不|暂不|别|禁止)\\s*(?:下载|获取全文|拿到全文)"
REFUSED_STEP = "(?:不要|不用|无需|不需要|先不|暂不)\\s*(?:下载|保存|存储|入库)"
TOPICS = (
    "(?i)(?:在|从|去)?\\s*(?:知网|CNKI|全网|联网|OpenAlex|arXiv|Crossref)?\\s*(?:中|上)?\\s*(?:搜索|搜一下|搜|检索|查找|查询|查)\\s*(.+)",
    "(?i)(?:换成|改成|主题(?:改为|换成|是)?|研究|关于)\\s*(.+)",
)
BOUNDARY = "(?:只(?:要|返回|展示)?|返回|展示|列出|推荐|并且|然后|并|下载|保存|存储|入库|加入知识库|放入知识库|不要下载|无需下载)"
QUERY_WORDS = (
    "我要重新|重新|再一次|再|存入知识库|放入知识库|保存到知识库|加入知识库|请|帮我|给我|去|知网中|知网上|知网|关于|相关的|相关|论文|文献|知识库|"
    "检索|搜索|搜一下|搜|查找|查询|下载|获取全文|拿到全文|保存|存储|入库|第\\s*[一二三四五六七八九十\\d]+\\s*(?:篇|个|条)|并且|然后|并",
    "(?:^|\\s)(?:在|从|去|请|帮我|给我|找|查|返回|展示|列出|推荐|获取)\\s*",
    "(?:返回|展示|列出|推荐|获取)?\\s*(?:第?[一二三四五六七八九十\\d]+|几|若干)\\s*(?:篇|条|个)?(?:结果|论文|文献)?",
)
STEP_WORDS = {"download_cnki_selections": ("下载", "获取全文", "拿到全文", "保存", "存储", "入库", "知识库"), "delete_knowledge": ("删除", "移除")}
INGEST = ("保存", "存储", "入库", "加入知识库", "放入知识库", "存到知识库")
PIPELINE = ("search_cnki_papers", "download_cnki_selections")
SEARCH_WORDS, DOWNLOAD_WORDS = ("检索", "搜索", "搜一下", "搜", "查找", "查询"), ("下载", "获取全文", "拿到全文")
STEPS = 4


def occurrences(text: Column, word: str) -> Column:
    """How often a word stands in a text, without overlaps."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("long")


def words_present(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words])


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return words_present(text, words) > 0


def route(content: Column, skill: Column, active_source: Column, pending: Column) -> Column:
    """(target, intent, execution_mode, score, reasons, confidence, capabilities, steps) of a request."""
    t, skill = F.coalesce(content, F.lit("")), F.coalesce(skill, F.lit("general_assistant"))
    long, many = F.char_length(t) > 180, reduce(lambda a, b: a + b, [occurrences(t, s) for s in SEPARATORS]) >= 4
    stages, listed = words_present(t, COMPLEX) >= 2, t.rlike("(?:第一|第二|1[.、]|2[.、])")
    score = long.cast("int") * 2 + many.cast("int") * 2 + stages.cast("int") * 2 + listed.cast("int")
    writing, audit, retrieval = (skill == "survey_review") | has_any(t, WRITING), (skill == "citation_audit") | has_any(t, AUDIT), (skill == "knowledge_base") | has_any(t, RETRIEVAL)
    # What each kind of request is called, what it can do and its steps.
    kinds = (
        (writing, "writing_agent", "academic_writing", "writing_intent", ("outline", "literature_retrieval", "section_writing", "quality_review"), ("clarify_scope", "route_writing_skill", "review_output")),
        (audit, "citation_agent", "citation_audit", "citation_audit_intent", ("citation_binding", "source_verification"), ("load_task_evidence", "verify_citations", "report_findings")),
        (retrieval, "research_agent", "knowledge_retrieval", "retrieval_intent", ("hybrid_retrieval", "source_ranking"), ("resolve_source", "retrieve", "synthesize")),
        (F.lit(True), "general_orchestrator", "general_chat", "general_intent", ("conversation",), ("respond",)),
    )

    def pick(i: int, make=F.lit) -> Column:
        out = make(kinds[-1][i])
        for k in reversed(kinds[:-1]):
            out = F.when(k[0], make(k[i])).otherwise(out)
        return out

    strings = lambda xs: F.array(*[F.lit(x) for x in xs])
    domain = writing | audit | retrieval
    source = F.coalesce(active_source, F.lit(""))
    reasons = F.filter(F.array(
        F.when(long, "long_request"), F.when(many, "multi_constraint"), F.when(stages, "multi_stage_reasoning"), F.when(listed, "explicit_steps"), pick(3),
        F.when(source != "", F.concat(F.lit("active_source:"), source)), F.when(F.coalesce(pending, F.lit(False)), "pending_action_present"),
    ), lambda x: x.isNotNull())
    return F.struct(
        pick(1).alias("target"), pick(2).alias("intent"), F.when((score >= 4) | (domain & (score >= 2)), "delegation").when(domain, "skill").otherwise("direct").alias("execution_mode"), score.alias("score"),
        F.array_distinct(reasons).alias("reasons"), F.when(domain, 0.96).otherwise(0.82).alias("confidence"), pick(4, strings).alias("capabilities"), pick(5, strings).alias("steps"),
    )


def command(content: Column) -> Column:
    """The tool of an exact command, or a search for a bare paper id; null for other requests."""
    bare = F.lower(F.regexp_replace(F.coalesce(content, F.lit("")), "[，。！？!?,\\s]+", ""))
    out = F.when(F.trim(content).rlike("^paper:[A-Za-z0-9_:\\-.]+$"), "search_papers")
    for tool, phrases in COMMANDS.items():
        out = F.when(bare.isin(*phrases), tool).otherwise(out)
    return out


def download_refused(content: Column) -> Column:
    return content.rlike(REFUSED)


def cleaned_query(content: Column) -> Column:
    """What is left of a request once the words of asking are gone; the request itself if nothing is."""
    q = F.coalesce(content, F.lit(""))
    for p in QUERY_WORDS:
        q = F.regexp_replace(q, p, " ")
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(q, "\\s+", " "), F.lit(" ，。；;、")), F.lit("")), F.trim(content))


# What a subject loses at its edges, in order: links, words of asking, instructions, later clauses, the word for papers, signs.
EDGES = (
    ("https?://\\S+", " "), ("^(?:请|麻烦|帮我|给我|我要|我想|去|在|从|重新|再|再一次)\\s*", ""), (f"(?s){BOUNDARY}.*$", ""), ("(?s)[，,。；;]\\s*(?:先|还是|就|再|然后)?.*$", ""),
    ("(?:相关的?|方面的?)?\\s*(?:论文|文献|文章)\\s*$", ""), ("[，,。；;：:]\\s*$", ""), ("\\s+", " "),
)


def _subject(text: Column) -> Column:
    return F.btrim(reduce(lambda t, e: F.regexp_replace(t, *e), EDGES, text), F.lit(" 的，,。；;：:"))


def research_topic(content: Column) -> Column:
    """The subject of a request: what follows a word of searching or changing, without instructions and edges."""
    t = F.trim(F.coalesce(content, F.lit("")))
    out = F.regexp_replace(t, f"(?s){BOUNDARY}.*$", "")
    for p in reversed(TOPICS):
        out = F.when(t.rlike(p), F.regexp_extract(t, p, 1)).otherwise(out)
    return _subject(out)


def _asks(content: Column) -> dict[str, Column]:
    """What the rules look for in a request."""
    t, low = F.coalesce(content, F.lit("")), F.lower(F.coalesce(content, F.lit("")))
    return {
        "text": t, "low": low, "wide": has_any(low, ("全网", "联网", "openalex", "arxiv", "crossref")), "search": has_any(t, SEARCH_WORDS), "download": has_any(t, DOWNLOAD_WORDS) & ~download_refused(t),
        "base": t.contains("知识库"), "link": first_link(t), "listed": t.contains("知识库") & has_any(t, ("有什么", "有哪些", "看看")),
    }


def deterministic_tool(content: Column, last_search: Column, had_cnki: Column, candidate: Column | None = None) -> Column:
    """The tool that rules choose for a request, first rule first; null where none does.

    ``candidate`` is the id of the paper that the conversation has chosen, if it has: then what is to be downloaded or kept
    without being named is that paper, and so is what is to be deleted.
    """
    q, known = _asks(content), lambda c: F.coalesce(c, F.lit("")) != ""
    t, search, download, base = q["text"], q["search"], q["download"], q["base"]
    cnki, chosen = F.coalesce(had_cnki, F.lit(False)), known(candidate) if candidate is not None else F.lit(False)
    go_on = ((F.coalesce(last_search, F.lit("")) == "search_cnki_papers") | cnki) & ~q["wide"] & ~base
    keep = has_any(t, ("保存", "存储", "入库"))
    rules = (
        (has_any(t, ("机构访问状态", "机构会话状态", "学校VPN状态", "学校 VPN 状态")), "institution_session_status"), (has_any(t, COMMANDS["start_institution_login"]), "start_institution_login"),
        (has_any(t, COMMANDS["confirm_institution_browser_login"]), "confirm_institution_browser_login"), ((t.contains("知网") | go_on) & search, "search_cnki_papers"),
        (t.contains("验证") & has_any(t, ("机构", "VPN", "权限", "访问")) & known(q["link"]), "verify_institution_access"), (download & known(q["link"]), "download_institution_url"),
        (download & cnki & t.rlike("\\d|第\\s*[一二三四五六七八九十]\\s*(?:篇|个|条)"), "download_cnki_selections"), (download & chosen, "acquire_paper_to_knowledge"), (download, "institution_session_status"),
        (has_any(t, ("断开机构", "退出机构", "撤销机构会话")), "revoke_institution_session"), (keep & chosen, "acquire_paper_to_knowledge"), (keep, "search_papers"),
        (has_any(t, ("删除", "移除")) & (known(first_paper_id(t)) | chosen), "delete_knowledge"), (search & has_any(t, ("论文", "文献", "知识库")), "search_papers"),
        (search & (F.coalesce(last_search, F.lit("")) == "search_papers"), "search_papers"), (q["listed"], "search_papers"), (q["low"].startswith("paper:"), "search_papers"),
    )
    out = F.lit(None).cast("string")
    for hit, tool in reversed(rules):
        out = F.when(hit, tool).otherwise(out)
    return out


def deterministic_plan(content: Column, last_search: Column, had_cnki: Column, candidate: Column | None = None) -> Column:
    """(tool_name, arguments) of ``deterministic_tool``; null where no rule holds. Arguments are texts, lists as JSON."""
    return once(F.coalesce(content, F.lit("")), lambda t: once(deterministic_tool(t, last_search, had_cnki, candidate), lambda tool: _with_arguments(t, tool, last_search, candidate)))


def _with_arguments(content: Column, tool: Column, last_search: Column, candidate: Column | None) -> Column:
    q = _asks(content)
    low, t = q["low"], q["text"]
    keep, own = has_any(t, ("保存", "存储", "入库")), F.coalesce(candidate, F.lit("")) if candidate is not None else F.lit("")
    named = q["search"] & has_any(t, ("论文", "文献", "知识库"))
    again = q["search"] & (F.coalesce(last_search, F.lit("")) == "search_papers")
    local = q["base"] & ~t.contains("联网")
    listed, whole = q["listed"] & ~keep & ~named & ~again, low.startswith("paper:") & ~keep & ~named & ~again & ~q["listed"]
    m = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))])
    source = F.when(low.contains("cnki") | t.contains("知网"), "cnki").when(low.contains("direct.mit.edu"), "mit_press").otherwise("institution")
    arguments = (
        F.when(tool == "search_cnki_papers", m(query=cleaned_query(t), limit="20")).when(tool == "verify_institution_access", m(probe_url=q["link"]))
        .when(tool == "download_institution_url", m(source_url=q["link"], source=source)).when(tool == "download_cnki_selections", m(indexes=F.to_json(chosen_places(t))))
        .when(tool == "acquire_paper_to_knowledge", m(paper_id=own)).when(tool == "delete_knowledge", m(paper_id=F.coalesce(F.nullif(first_paper_id(t), F.lit("")), own)))
        .when((tool == "search_papers") & listed, m(query="", source="local", limit="10")).when((tool == "search_papers") & whole, m(query=t, source="local", limit="5"))
        .when(tool == "search_papers", m(query=cleaned_query(t), source=F.when(named & local & ~keep, "local").otherwise("all"), limit="5")).otherwise(F.create_map().cast("map<string,string>"))
    )
    return F.when(tool.isNotNull(), F.struct(tool.alias("tool_name"), arguments.alias("arguments")))


def combined_plan(content: Column, had_cnki: Column) -> Column:
    """(query, places) of a request that searches and downloads in one; places are 1 where it names none. Null for others."""
    return once(F.coalesce(content, F.lit("")), lambda t: _combined(t, had_cnki))


def _combined(content: Column, had_cnki: Column) -> Column:
    q = _asks(content)
    both = (q["text"].contains("知网") | (F.coalesce(had_cnki, F.lit(False)) & ~q["wide"])) & q["search"] & q["download"]
    places = chosen_places(q["text"], bare=False)
    return F.when(both, F.struct(cleaned_query(q["text"]).alias("query"), F.when(F.size(places) > 0, places).otherwise(F.array(F.lit(1))).alias("places")))


def budget_class(content: Column) -> Column:
    """Tokens of context for a request: 3000 to recall, 7000 for complex, 4200 for actions, else 2600."""
    t = F.coalesce(content, F.lit(""))
    return F.when(has_any(t, RECALL_PHRASES), 3000).when((F.char_length(t) > 280) | (words_present(t, COMPLEX_PHRASES) >= 2), 7000).when(has_any(t, ACTION_PHRASES), 4200).otherwise(2600)


def budgets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in BUDGETS.items()], "purpose string, max_input_tokens int, max_output_tokens int, cache_ttl_seconds int")


def with_budget(calls: DataFrame) -> DataFrame:
    """``calls`` (purpose) with their budget; purposes that the table doesn't name get the default."""
    names = ("max_input_tokens", "max_output_tokens", "cache_ttl_seconds")
    return calls.join(F.broadcast(budgets(calls.sparkSession)), "purpose", "left").fillna(dict(zip(names, DEFAULT_BUDGET)))  # ten rows


def valid_steps(steps: Column, content: Column, available: Column) -> Column:
    """Of a plan's first four ``steps`` (tool_name, arguments map), those that may run.

    Unknown tools go, and so do downloads and deletions that the request doesn't ask for or refuses. A search that is to
    be stored is followed by a download; any other plan of several steps keeps its first.
    """
    wanted = {k: has_any(content, v) for k, v in STEP_WORDS.items()}
    name = lambda s: s["tool_name"]

    def may(s: Column) -> Column:
        return (
            F.array_contains(available, name(s)) & ((name(s) != "download_cnki_selections") | (wanted["download_cnki_selections"] & ~content.rlike(REFUSED_STEP)))
            & ((name(s) != "delete_knowledge") | wanted["delete_knowledge"])
        )

    bare = F.transform(F.filter(F.slice(F.coalesce(steps, F.array().cast("array<struct<tool_name:string,arguments:map<string,string>>>")), 1, STEPS), may), lambda s: F.struct(
        name(s).alias("tool_name"), F.map_filter(s["arguments"], lambda k, v: ~k.isin("tenant_id", "user_id", "confirmation_token")).alias("arguments")))
    store = (F.get(bare, F.lit(0))["tool_name"] == PIPELINE[0]) & F.array_contains(available, PIPELINE[1]) & has_any(content, INGEST) & ~content.rlike(REFUSED_STEP)
    pair = F.array(F.get(bare, F.lit(0)), F.struct(F.lit(PIPELINE[1]).alias("tool_name"), F.create_map(F.lit("indexes"), F.lit("1")).alias("arguments")))
    names = F.transform(bare, name)
    whole = names == F.array(*[F.lit(x) for x in PIPELINE])
    return F.when(store, pair).when((F.size(bare) > 1) & ~whole, F.slice(bare, 1, 1)).otherwise(bare)


def search_arguments(tool: Column, query: Column, limit: Column, source: Column) -> Column:
    """(query, limit, source) of a search, in their bounds; null where there is no query."""
    usual = F.when(tool == "search_cnki_papers", 20).otherwise(5)
    low = F.lower(F.coalesce(F.nullif(source, F.lit("")), F.lit("all")))
    q = F.nullif(collapsed(query), F.lit(""))
    return F.when(q.isNotNull(), F.struct(
        q.alias("query"), F.least(F.greatest(F.coalesce(limit.try_cast("int"), usual), F.lit(1)), F.lit(50)).alias("limit"),
        F.when(tool == "search_papers", F.when(low.isin("all", "local", "openalex", "arxiv", "crossref"), low).otherwise("all")).alias("source"),
    ))


def search_source(strategy: Column) -> Column:
    s = F.lower(F.coalesce(strategy, F.lit("online")))
    return F.when(s == "local", "local").when(s == "hybrid", "all").otherwise("external")


def catalog_entry(requests: DataFrame, catalog: DataFrame, key: str = "skill_id") -> DataFrame:
    """``requests`` with the catalog's row of their key, or its first (``position``) where it has none."""
    first = catalog.orderBy("position").limit(1).select(*[F.col(c).alias(f"__{c}") for c in catalog.columns if c != key], F.col(key).alias("__key"))
    d = requests.withColumnRenamed(key, "__asked").join(catalog, F.col("__asked") == catalog[key], "left").join(F.broadcast(first), F.lit(True), "left")  # one row
    rest = [c for c in catalog.columns if c != key]
    return d.select(*[c for c in requests.columns if c != key], F.coalesce(key, "__key").alias(key), *[F.coalesce(c, f"__{c}").alias(c) for c in rest])


# What makes an argument part of a recipe, and what takes it out.
VARIABLE, IGNORED, SENSITIVE = ("query", "paper_id", "source_url", "conversation_id", "title", "content"), ("tenant_id", "user_id", "confirmation_token", "task_id"), "(?i)token|password|secret|api.?key|authorization"


def recipe(arguments: Column) -> Column:
    """A map of JSON values as a recipe, sorted by name: variables and lists as {{name}}, scalars as they are, objects and
    secrets left out."""
    kept = F.filter(F.array_sort(F.map_entries(arguments)), lambda e: ~e["key"].isin(*IGNORED) & ~e["key"].rlike(SENSITIVE) & (e["key"].isin(*VARIABLE) | ~e["value"].rlike("^\\s*(?:\\{|null)")))
    hole = lambda e: e["key"].isin(*VARIABLE) | e["value"].rlike("^\\s*\\[")
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"].alias("key"), F.when(hole(e), F.concat(F.lit('"{{'), e["key"], F.lit('}}"'))).otherwise(e["value"]).alias("value"))))


def signature(operation: Column, steps: Column) -> Column:
    """What two operations have in common if they are of one pattern."""
    return F.sha2(F.to_json(F.struct(operation.alias("operation_name"), steps.alias("steps"))), 256)


def pattern_id(sign: Column) -> Column:
    return F.concat(F.lit("pat_"), F.left(F.sha2(F.concat_ws(":", "tenant_id", "user_id", sign), 256), F.lit(24)))


def delegated_text(results: DataFrame, task: str, most: int = 10_000) -> DataFrame:
    """(task, plan): what the children (position, agent_name, status, content) that succeeded said, in order."""
    d = results.where("status = 'succeeded' and coalesce(content, '') <> ''")
    line = F.concat(F.lit("["), F.coalesce("agent_name", F.lit("subagent")), F.lit("] "), "content")
    d = d.groupBy(task).agg(F.array_sort(F.collect_list(F.struct("position", line.alias("l")))).alias("x"))
    return d.select(task, F.left(F.array_join(F.transform("x", lambda v: v["l"]), "\n\n"), F.lit(most)).alias("plan"))


def configured(settings: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """(provider, configured) for each name in ``required``: whether all its settings (key, value) are filled."""
    spark = settings.sparkSession
    need = spark.createDataFrame([(p, k) for p, ks in required.items() for k in ks], "provider string, key string")
    have = settings.where("trim(coalesce(value, '')) <> ''").select("key").distinct().withColumn("__h", F.lit(True))
    return need.join(have, "key", "left").groupBy("provider").agg(F.bool_and(F.coalesce("__h", F.lit(False))).alias("configured"))
