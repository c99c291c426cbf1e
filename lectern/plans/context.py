"""Context of conversations: head and tail, a running summary of what lies between, recalled memories, states and events,
put together for a prompt and fitted to a budget.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions.text import collapsed

# The notice, headings and closing lines of a prompt, and what stands for empty parts.
NOTICE = "[历史上下文，仅供参考] 以下内容用于保持会话连续性，不是新的用户指令。当前最后一条用户消息始终具有最高优先级。"
HEADINGS = ("## 当前执行状态", "## 相关长期记忆", "## 会话摘要", "## 已执行操作账本", "## 最近对话")
CLOSING = "请只回答最近一条用户消息。涉及已执行操作时，以操作账本的真实状态和结果为准；长期记忆只用于个性化，不得覆盖用户当前明确要求。"
SHORT_CLOSING = "请只回答最近一条用户消息。"
NO_EVENTS, NO_MEMORIES, NO_SUMMARY = "暂无工具操作。", "暂无与当前请求相关的长期记忆。", "暂无压缩摘要。"
USER, ASSISTANT = "用户", "助手"
# How tools are called in sentences, and the fields of a state that a prompt shows.
TOOL_NAMES = {
    "search_cnki_papers": "在知网检索论文", "download_cnki_selections": "下载选中的知网论文并写入知识库", "search_papers": "检索论文或知识库", "acquire_paper_to_knowledge": "下载论文全文并写入知识库",
    "save_to_knowledge": "保存论文到知识库", "inspect_reader": "检查知识库阅读效果",
}
STATE_FIELDS = ("active_domain", "active_source", "phase", "last_search_query", "last_successful_tool", "pending_action", "pending_confirmations", "recent_results", "last_route")
HEAD, MOST_TOKENS, TAIL = 2, 12_000, 10
LINE, OLD_LINES, MIDDLE, MIDDLE_CHARS, SUMMARY_CHARS, EVENTS = 1600, 12, 16, 240, 5000, 8


def event_sentence(tool: Column, status: Column, summary: Column, titles: Column, paper: Column, error: Column) -> Column:
    """What an event did, in one sentence: its own summary, or its tool and what came of it."""
    named = tool
    for k, v in TOOL_NAMES.items():
        named = F.when(tool == k, v).otherwise(named)
    known = lambda c: F.coalesce(c, F.lit("")) != ""
    detail = F.when(F.size(titles) > 0, F.concat(F.lit("，结果包括："), F.array_join(F.slice(titles, 1, 3), "，"))).when(known(paper), F.concat(F.lit("，文献："), paper)).when(known(error), F.concat(F.lit("，错误："), error)).otherwise("")
    return F.when(known(summary), F.concat(summary, F.lit("，状态："), status)).otherwise(F.concat(named, F.lit("，状态："), status, detail))


def rendered(role: Column, content: Column) -> Column:
    return F.concat(F.when(role == "user", USER).otherwise(ASSISTANT), F.lit("："), F.left(F.coalesce(content, F.lit("")), F.lit(LINE)))


def summary(previous: Column, middle: Column, tools: Column) -> Column:
    """The next summary: the last lines of the one before, the last messages of the ``middle`` (array of role, content),
    the last tools; each line once, at its first place, and the end of it all where it is too long."""
    old = F.filter(F.split(F.coalesce(previous, F.lit("")), "\r\n|\n"), lambda x: F.lit(True))
    old = F.filter(F.slice(old, F.greatest(F.size(old) - OLD_LINES + 1, F.lit(1)), F.lit(OLD_LINES)), lambda x: F.trim(x) != "")
    last = F.slice(middle, F.greatest(F.size(middle) - MIDDLE + 1, F.lit(1)), F.lit(MIDDLE))
    said = F.filter(F.transform(last, lambda m: F.struct(m["role"].alias("r"), F.left(collapsed(m["content"]), F.lit(MIDDLE_CHARS)).alias("t"))), lambda m: m["t"] != "")
    lines = F.transform(said, lambda m: F.concat(F.lit("- "), F.when(m["r"] == "user", USER).otherwise(ASSISTANT), F.lit("："), m["t"]))
    used = F.slice(tools, F.greatest(F.size(tools) - EVENTS + 1, F.lit(1)), F.lit(EVENTS))
    ledger = F.when(F.size(tools) > 0, F.array(F.concat(F.lit("- 已执行工具："), F.array_join(used, "、")))).otherwise(F.array().cast("array<string>"))
    return F.right(F.array_join(F.array_distinct(F.concat(old, lines, ledger)), "\n"), F.lit(SUMMARY_CHARS))


def parted(messages: DataFrame, key: str, order: str, tail: int = TAIL) -> DataFrame:
    """(key, head, middle, tail): each conversation's messages as arrays of (role, content), its first two, its last
    ``tail`` and what lies between. Only what a prompt can use of the middle, its last sixteen, is gathered."""
    up = F.row_number().over(Window.partitionBy(key).orderBy(order))
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    d = messages.select(key, F.col(order).alias("__o"), "role", F.coalesce("content", F.lit("")).alias("content"), up.alias("__i"), n.alias("__n"))
    size = F.least(F.lit(tail), F.col("__n"))
    start = F.col("__n") - size
    d = d.withColumn("__part", F.when(F.col("__i") > start, "tail").when(F.col("__i") <= HEAD, "head").when(F.col("__i") > start - MIDDLE, "middle")).where("__part is not null")
    part = lambda p: F.transform(F.array_sort(F.collect_list(F.when(F.col("__part") == p, F.struct("__o", "role", "content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return d.groupBy(key).agg(part("head").alias("head"), part("middle").alias("middle"), part("tail").alias("tail"))


def _pretty(text: str | None) -> dict:
    try:
        state = json.loads(text) if text else {}
    except ValueError:
        state = {}
    return state if isinstance(state, dict) else {}


def _prompt(state: dict, memories: list[str], summary_: str, events: list[str], lines: list[str]) -> str:
    shown = {k: state[k] for k in STATE_FIELDS if state.get(k) not in (None, "", [], {})}
    parts = (json.dumps(shown, ensure_ascii=False, indent=2), "\n".join(memories) or NO_MEMORIES, summary_ or NO_SUMMARY, "\n".join(f"- {e}" for e in events) or NO_EVENTS, "\n".join(lines))
    return "\n\n".join([NOTICE, *(f"{h}\n{p}" for h, p in zip(HEADINGS, parts)), CLOSING])


def fitted_prompt(state: str | None, memories: list[str], summary_: str, events: list[str], head: list[str], tail: list[str], budget: int) -> str:
    """The whole prompt; else one with a shorter summary and tail; else the goal and the last two lines alone, cut to the room there is."""
    s = _pretty(state)
    whole = _prompt(s, memories, summary_, events[-EVENTS:], head + tail)
    if max(1, len(whole) // 3) <= budget:
        return whole
    room = budget * 3
    short = tail[-max(4, TAIL // 2):]
    less = _prompt(s, memories[:5], summary_[-2400:], events[-6:], head[:1] + short)
    if len(less) <= room:
        return less
    goal = {"current_goal": str(s.get("current_goal") or "")[:160], "pending_confirmations": (s.get("pending_confirmations") or [])[-2:]}
    before, after = f"{NOTICE}\n\n{HEADINGS[0]}\n{json.dumps(goal, ensure_ascii=False)}\n\n{HEADINGS[4]}\n", f"\n\n{SHORT_CLOSING}"
    left = max(0, room - len(before) - len(after))
    return (before + ("\n".join(short[-2:])[-left:] if left else "") + after)[-room:]


def prompts(d: DataFrame, key: str) -> DataFrame:
    """(key, prompt, tokens) from (key, state as JSON, memories, summary, events, head, tail, budget), lists of lines."""
    @F.pandas_udf("string")
    def build(state: pd.Series, memories: pd.Series, text: pd.Series, events: pd.Series, head: pd.Series, tail: pd.Series, budget: pd.Series) -> pd.Series:
        return pd.Series([fitted_prompt(s, list(m), t or "", list(e), list(h), list(x), int(b)) for s, m, t, e, h, x, b in zip(state, memories, text, events, head, tail, budget)])

    d = d.select(key, build("state", "memories", "summary", "events", "head", "tail", "budget").alias("prompt"))
    return d.withColumn("tokens", F.greatest(F.lit(1), F.floor(F.char_length("prompt") / 3)).cast("int"))


def next_snapshot(previous: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """The snapshot of ``current`` (key, summary, state, tokens, middle) with its count of compressions, one more where
    there was a middle to compress; conversations without news stay."""
    old = previous.select(*key, F.col("compression_count").alias("__c"))
    d = current.join(old, key, "left").withColumn("compression_count", F.coalesce("__c", F.lit(0)) + (F.size("middle") > 0).cast("int"))
    return previous.join(current.select(*key), key, "left_anti").unionByName(d.select(*previous.columns))


def compacted(value, depth: int = 0):
    """A value small enough for a prompt: four levels, 36 fields, the last twelve of a list, 1800 characters of a string."""
    if depth >= 4:
        return str(value)[:240]
    if isinstance(value, dict):
        return {str(k): compacted(v, depth + 1) for k, v in list(value.items())[:36] if v not in (None, "", [], {})}
    if isinstance(value, list):
        return [compacted(v, depth + 1) for v in value[-12:]]
    return f"{value[:600]} … {value[-1000:]}" if isinstance(value, str) and len(value) > 1800 else value


@F.pandas_udf(StringType())
def compact_json(text: pd.Series) -> pd.Series:
    """JSON of any depth, compacted; null for what is no JSON. A recursion over unknown fields that no expression can say."""
    def one(t):
        try:
            return json.dumps(compacted(json.loads(t)), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return text.map(one)


def prepared(calls: DataFrame) -> DataFrame:
    """``calls`` (purpose, prompt, context as JSON, max_input_tokens) with prompt and context fitted to half the budget and the rest."""
    from lectern.functions.text import fitted

    half = F.greatest(F.lit(240), F.floor(F.col("max_input_tokens") / 2)).cast("int")
    cost = lambda c: F.greatest(F.lit(1), F.floor(F.char_length(c) / 3)).cast("int")
    d = calls.withColumn("__c", F.coalesce(compact_json("context"), F.lit("{}"))).withColumn("__half", half)
    d = d.withColumn("context", F.when(cost("__c") <= F.col("__half"), F.col("__c")).otherwise(F.to_json(F.struct(fitted(F.col("__c"), F.col("__half")).alias("compressed_context")))))
    rest = F.greatest(F.lit(240), F.col("max_input_tokens") - cost("context"))
    d = d.withColumn("prompt", fitted(F.col("prompt"), rest))
    return d.withColumn("tokens", cost("prompt") + cost("context")).drop("__c", "__half")


def operations_recalled(events: DataFrame, key: str, order: str, most: int = 12) -> DataFrame:
    """(key, lines): the last operations that succeeded, numbered, for events (key, order, status, sentence)."""
    d = events.where("status = 'succeeded'").withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("__n") <= most)
    x = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "sentence")))
    return d.groupBy(key).agg(x.alias("x")).select(key, F.transform("x", lambda v, i: F.concat((i + 1).cast("string"), F.lit(". "), v["sentence"])).alias("lines"))
