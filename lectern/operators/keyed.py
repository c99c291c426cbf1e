"""Writes to keyed tables, as the table that follows: upserts, partial updates, deletes, toggles, counters, caches.

Tables are values: each function gives the next state as one plan, and ``lectern.scratch.write_version`` puts it in
place as a whole. Keys are equal only where no part is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_of_each(delta: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of rows with one key the last in ``order``; ``order`` columns that the table lacks can be dropped after."""
    rest = [c for c in delta.columns if c not in key]
    d = delta.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return d.select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def upsert_keeping(base: DataFrame, delta: DataFrame, key: list[str], keep: list[str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """``base`` with the rows of ``delta`` (one a key) in place of those of their keys, but for columns ``keep``, which
    known rows keep; new rows get ``defaults``, or what ``delta`` says."""
    defaults = defaults or {}
    old = base.select(*key, F.lit(True).alias("__known"), *[F.col(c).alias(f"__{c}") for c in keep])
    d = delta.join(old, key, "left")
    for c in keep:
        new = defaults.get(c, F.col(c) if c in delta.columns else F.lit(None))
        d = d.withColumn(c, F.when(F.col("__known"), F.col(f"__{c}")).otherwise(new).cast(base.schema[c].dataType))
    return base.join(delta.select(*key), key, "left_anti").unionByName(d.select(*base.columns))


def updated_columns(base: DataFrame, delta: DataFrame, key: list[str], allowed: list[str]) -> DataFrame:
    """``base`` with those of the ``allowed`` columns that ``delta`` (one row a key) has and doesn't leave null."""
    names = [c for c in delta.columns if c in allowed and c not in key]
    d = base.join(delta.select(*key, *[F.col(c).alias(f"__{c}") for c in names]), key, "left")
    return d.withColumns({c: F.coalesce(f"__{c}", c) for c in names}).select(*base.columns)


def deleted(base: DataFrame, keys: DataFrame, key: list[str], allowed: Column | None = None) -> DataFrame:
    """``base`` without the keys; rows for which ``allowed`` isn't true stay."""
    gone = base.join(keys.select(*key).distinct(), key, "left_semi")
    if allowed is not None:
        gone = gone.where(allowed)
    return base.join(gone.select(*key).distinct(), key, "left_anti")


def marked(base: DataFrame, keys: DataFrame, key: list[str], column: str, value: str, now: Column | None = None) -> DataFrame:
    """``base`` with ``column`` set to ``value`` for the keys, and ``updated_at`` to ``now``: a delete that leaves the row."""
    d = base.join(keys.select(*key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    d = d.withColumn(column, F.when(F.col("__hit"), value).otherwise(F.col(column)))
    if now is not None and "updated_at" in base.columns:
        d = d.withColumn("updated_at", F.when(F.col("__hit"), now).otherwise(F.col("updated_at")))
    return d.select(*base.columns)


def members(papers: DataFrame, flag: str = "in_knowledge_base") -> DataFrame:
    """Papers that are in the knowledge base. Chunks are built from these alone, so a toggle off takes them out of search,
    and no index can hold what the table doesn't."""
    return papers.where(F.col(flag))


def with_parent_times(parents: DataFrame, children: DataFrame, key: list[str], time: str = "created_at", out: str = "updated_at") -> DataFrame:
    """``parents`` with the time of their last child, if that is later than their own."""
    last = children.groupBy(*key).agg(F.max(time).alias("__last"))
    return parents.join(last, key, "left").withColumn(out, F.greatest(out, "__last")).select(*parents.columns)


def counted(base: DataFrame, hits: DataFrame, key: list[str], counter: str, distinct: bool = True) -> DataFrame:
    """``base`` with ``counter`` raised by the hits of each key, or by one where ``distinct``."""
    n = hits.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    d = base.join(n, key, "left")
    step = F.when(F.col("__n").isNull(), 0).otherwise(F.lit(1) if distinct else F.col("__n"))
    return d.withColumn(counter, (F.coalesce(counter, F.lit(0)) + step).cast(base.schema[counter].dataType)).select(*base.columns)


def with_parent(children: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """Children whose parent is there: what a cascading delete leaves."""
    return children.join(parents.select(*key).distinct(), key, "left_semi")


def has_any(base: DataFrame, log: DataFrame, key: list[str], out: str) -> DataFrame:
    """Adds ``out``: whether the log has a row of the key."""
    d = base.join(log.select(*key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    return d.withColumn(out, F.coalesce("__hit", F.lit(False))).drop("__hit")


# What tells one translation from another.
TRANSLATION = ["tenant_id", "user_id", "paper_id", "source_hash", "target_language"]


def translation_keys(requests: DataFrame) -> DataFrame:
    """``requests`` with blanks collapsed and the hash of their text."""
    text = F.trim(F.regexp_replace(F.coalesce("source_text", F.lit("")), "\\s+", " "))
    return requests.withColumn("source_text", text).withColumn("source_hash", F.sha2(text, 256))


def looked_up(requests: DataFrame, cache: DataFrame, computed: Column) -> DataFrame:
    """``requests`` with ``translated_text`` from the cache, or else as ``computed``, and whether it was ``cached``."""
    c = cache.select(*TRANSLATION, F.col("translated_text").alias("__old"))
    d = translation_keys(requests).join(c, TRANSLATION, "left").withColumn("cached", F.col("__old").isNotNull())
    return d.withColumn("translated_text", F.coalesce("__old", computed)).drop("__old")


def cache_filled(cache: DataFrame, answered: DataFrame) -> DataFrame:
    """``cache`` with the answers that it didn't have, one for each key."""
    new = answered.where(~F.col("cached")).groupBy(*TRANSLATION).agg(F.min("translated_text").alias("translated_text"))
    return cache.unionByName(new.join(cache.select(*TRANSLATION), TRANSLATION, "left_anti").select(*cache.columns))


def exploded_strokes(annotations: DataFrame, key: list[str], most: int = 1000) -> DataFrame:
    """Rows of drawings (``strokes``) and one more for ``notes`` if there are any: (*key, position, page, type, color, points, content)."""
    s = annotations.select(*key, F.posexplode(F.slice("strokes", 1, most)).alias("position", "s"))
    s = s.select(
        *key, "position", F.coalesce("s.page", F.lit(0)).alias("page"), F.coalesce("s.type", F.lit("highlight")).alias("annotation_type"), F.col("s.color").alias("color"),
        F.col("s.points").alias("points"), F.coalesce("s.content", F.lit("")).alias("content"),
    )
    n = annotations.where("coalesce(notes, '') <> ''").select(
        *key, F.least(F.size("strokes"), F.lit(most)).alias("position"), F.lit(0).alias("page"), F.lit("note").alias("annotation_type"), F.lit(None).cast("string").alias("color"),
        F.array().cast(s.schema["points"].dataType).alias("points"), F.col("notes").alias("content"),
    )
    return s.unionByName(n)


def gathered_strokes(rows: DataFrame, key: list[str]) -> DataFrame:
    """Drawings and joined notes of each key again, by page and position."""
    note = F.col("annotation_type") == "note"
    own = F.struct("page", "position", "annotation_type", "color", "points", "content")
    d = rows.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(~note, own))).alias("strokes"),
        F.array_sort(F.collect_list(F.when(note & (F.coalesce("content", F.lit("")) != ""), F.struct("page", "position", "content")))).alias("__notes"),
    )
    return d.withColumn("notes", F.array_join(F.transform("__notes", lambda x: x["content"]), "\n")).drop("__notes")


def settings_after(table: DataFrame, incoming: DataFrame, secrets: list[str], known: list[str] | None = None) -> DataFrame:
    """``table`` (key, value) after ``incoming``: blanks take a setting out, but a blank secret leaves it as it was."""
    n = incoming if known is None else incoming.where(F.col("key").isin(*known))
    n = n.withColumn("value", F.trim(F.coalesce("value", F.lit(""))))
    n = n.where(~(F.col("key").isin(*secrets) & (F.col("value") == "")))
    return table.join(n.select("key").distinct(), "key", "left_anti").unionByName(n.where("value <> ''").select(*table.columns))


def settings_in_force(names: DataFrame, table: DataFrame, environment: DataFrame, options: dict[str, list[str]] | None = None, secrets: list[str] = ()) -> DataFrame:
    """``names`` (key, default) with the value in force (table, then environment, then default), where it is from, whether
    it is one of the key's options, and how it may be shown."""
    from lectern.functions.text import masked

    d = names.join(table.select("key", F.col("value").alias("__t")), "key", "left").join(environment.select("key", F.col("value").alias("__e")), "key", "left")
    d = d.withColumn("value", F.coalesce("__t", "__e", "default"))
    d = d.withColumn("origin", F.when(F.col("__t").isNotNull(), "table").when(F.col("__e").isNotNull(), "environment").otherwise("default"))
    valid = F.lit(True)
    for k, v in (options or {}).items():
        valid = F.when(F.col("key") == k, (F.col("value") == "") | F.col("value").isin(*v)).otherwise(valid)
    shown = F.when(F.col("key").isin(*secrets), masked(F.col("value"))).otherwise(F.col("value")) if secrets else F.col("value")
    return d.withColumns({"valid": valid, "shown": shown}).drop("__t", "__e", "default")


def as_bool(value: Column) -> Column:
    return F.lower(F.trim(value)).isin("1", "true", "yes", "on")
