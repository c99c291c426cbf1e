"""Memories of users: found in messages by rules, kept once each, recalled by overlap, importance and recency.

A memory is (memory_id, tenant_id, user_id, memory_type, content, normalized_content, importance, confidence,
access_count, last_accessed_at, status, created_at, updated_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import collapsed, memory_tokens, normalised_memory, overlap, parsed_time, recency

# What marks a memory in a message, its type, its importance, and the group that is kept.
RULES = (
    ("instruction", "(?:请)?记住(?:我|：|:)?(.+)", 0.95, 1),
    ("preference", "(?:我|本人)?(?:偏好|喜欢|习惯|倾向于)(.+)", 0.86, 0),
    ("constraint", "(?:以后|后续|始终|一直)(?:请|要|需要)?(.+)", 0.82, 0),
    ("constraint", "(?:不要|不能|禁止)(.+)", 0.88, 0),
    ("profile", "(?:我的|我目前的)(?:研究方向|课题|项目|领域)(?:是|为|：|:)?(.+)", 0.9, 0),
    ("preference", "(?:引用|参考文献)(?:格式|风格)(?:使用|采用|是|为|：|:)?(.+)", 0.88, 0),
)
# Weights of the recall score, and the importance that recalls a memory without overlap.
OVERLAP, IMPORTANCE, RECENCY, CONFIDENCE, ALWAYS = 0.55, 0.25, 0.15, 0.05, 0.82
SCOPE = ["tenant_id", "user_id"]
RECENT, PER_MESSAGE, POOL = 6, 3, 100


def memory_id(memory_type: Column, normalised: Column) -> Column:
    return F.concat(F.lit("mem_"), F.left(F.sha2(F.concat_ws("|", "tenant_id", "user_id", memory_type, normalised), 256), F.lit(32)))


def extracted(messages: DataFrame, conversation: str = "conversation_id", order: str = "position") -> DataFrame:
    """What users said that is worth keeping, from the last six of ``messages`` (tenant, user, conversation, order, role,
    content) of each conversation: at most three memories a message, none whose normalised text has under 3 characters."""
    w = Window.partitionBy(*SCOPE, conversation).orderBy(F.desc(order))
    d = messages.withColumn("__n", F.row_number().over(w)).where((F.col("__n") <= RECENT) & (F.col("role") == "user"))
    d = d.withColumn("__text", F.left(collapsed(F.col("content")), F.lit(1200)))
    found = F.array(*[
        F.when(F.col("__text").rlike(p), F.struct(F.lit(kind).alias("memory_type"), F.left(F.regexp_extract("__text", p, group), F.lit(500)).alias("content"), F.lit(weight).alias("importance")))
        for kind, p, weight, group in RULES
    ])
    d = d.select(*SCOPE, conversation, order, F.posexplode(F.slice(F.filter(found, lambda x: x.isNotNull()), 1, PER_MESSAGE)).alias("rule", "m"))
    d = d.select(*SCOPE, conversation, order, "rule", "m.memory_type", F.trim("m.content").alias("content"), normalised_memory(F.col("m.content")).alias("normalized_content"), "m.importance")
    return d.where(F.char_length("normalized_content") >= 3).withColumn("memory_id", memory_id(F.col("memory_type"), F.col("normalized_content")))


def remembered(memories: DataFrame, new: DataFrame, now: Column, order: list[str]) -> DataFrame:
    """``memories`` with ``new`` (scope, memory_type, content, importance and ``order``): one row a memory.

    A memory that was known gets its new content and importance and is active again, even if it had been forgotten; its
    access count, last access and creation time stay. Of new rows for one memory the last in ``order`` holds.
    """
    n = new.withColumn("normalized_content", normalised_memory(F.col("content"))).where(F.char_length("normalized_content") >= 3)
    n = n.withColumn("memory_id", memory_id(F.col("memory_type"), F.col("normalized_content")))
    rest = [*SCOPE, "memory_type", "content", "normalized_content", "importance"]
    n = n.groupBy("memory_id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select("memory_id", *[F.col(f"r.{c}").alias(c) for c in rest])
    old = memories.select("memory_id", F.col("access_count").alias("__a"), F.col("last_accessed_at").alias("__l"), F.col("created_at").alias("__c"))
    n = n.join(old, "memory_id", "left").select(
        "memory_id", *SCOPE, "memory_type", F.trim("content").alias("content"), "normalized_content", F.col("importance").cast("double").alias("importance"), F.lit(1.0).alias("confidence"),
        F.coalesce("__a", F.lit(0)).cast("long").alias("access_count"), F.col("__l").alias("last_accessed_at"), F.lit("active").alias("status"),
        F.coalesce("__c", now).alias("created_at"), now.alias("updated_at"),
    )
    return memories.join(n.select("memory_id"), "memory_id", "left_anti").unionByName(n)


def recalled(memories: DataFrame, requests: DataFrame, now: Column, limit: int = 8) -> DataFrame:
    """(tenant, user, memory_id, memory_type, content, importance, score, rank) for each of ``requests`` (tenant, user, query).

    Of each user, the hundred most important and newest active memories are looked at; those with a token in common with
    the query or of high importance are ranked by overlap, importance, recency and confidence. Blank importance counts
    as 0.5, blank confidence as 1; times that can't be read count as now. One request a user.
    """
    when_ = F.when(F.col("updated_at").isNull(), now).otherwise(parsed_time(F.col("updated_at").cast("string"), now))
    pool = Window.partitionBy(*SCOPE).orderBy(F.desc("importance"), F.desc("updated_at"), "memory_id")
    d = memories.where("status = 'active'").withColumn("__n", F.row_number().over(pool)).where(F.col("__n") <= POOL)
    d = d.join(requests.select(*SCOPE, memory_tokens(F.col("query")).alias("__q")), SCOPE)
    own = memory_tokens(F.coalesce(F.nullif("normalized_content", F.lit("")), "content"))
    importance, confidence = (F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(x)) for c, x in (("importance", 0.5), ("confidence", 1.0)))
    d = d.withColumns({"__o": overlap(F.col("__q"), own), "importance": importance, "__r": recency(when_, now), "__c": confidence})
    d = d.where((F.col("__o") > 0) | (F.col("importance") >= ALWAYS))
    d = d.withColumn("score", OVERLAP * F.col("__o") + IMPORTANCE * F.col("importance") + RECENCY * F.col("__r") + CONFIDENCE * F.col("__c"))
    rank = F.row_number().over(Window.partitionBy(*SCOPE).orderBy(F.desc("score"), F.col("__n")))
    return d.withColumn("rank", rank).where(F.col("rank") <= limit).select(*SCOPE, "memory_id", "memory_type", "content", "importance", "score", "rank")


def touched(memories: DataFrame, used: DataFrame, now: Column) -> DataFrame:
    """``memories`` with one access more for those in ``used`` (memory_id)."""
    d = memories.join(used.select("memory_id").distinct().withColumn("__u", F.lit(1)), "memory_id", "left")
    hit = F.col("__u").isNotNull()
    d = d.withColumn("access_count", F.col("access_count") + hit.cast("long")).withColumn("last_accessed_at", F.when(hit, now).otherwise(F.col("last_accessed_at")))
    return d.select(*memories.columns)


def forgotten(memories: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """``memories`` in which those of ``ids`` (tenant, user, memory_id) stay, but are no longer active."""
    d = memories.join(ids.select(*SCOPE, "memory_id").distinct().withColumn("__u", F.lit(1)), [*SCOPE, "memory_id"], "left")
    hit = F.col("__u").isNotNull()
    d = d.withColumn("status", F.when(hit, "forgotten").otherwise(F.col("status"))).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))
    return d.select(*memories.columns)


def listed(memories: DataFrame, tenant: str, user: str, limit: int = 50) -> DataFrame:
    """A user's active memories, the most important and newest first, 1 to 200 of them."""
    d = memories.where((F.col("tenant_id") == tenant) & (F.col("user_id") == user) & (F.col("status") == "active"))
    return d.orderBy(F.desc("importance"), F.desc("updated_at"), "memory_id").limit(max(1, min(limit, 200)))


def context_lines(found: DataFrame) -> DataFrame:
    """(tenant, user, lines): recalled memories as they stand in a prompt, best first."""
    line = F.format_string("- [%s] %s", "memory_type", "content")
    return found.groupBy(*SCOPE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))


