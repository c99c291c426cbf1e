"""Ordered sets and unions: sources by priority, merged events, recent references, chosen places."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The numerals of places.
NUMERALS = {n: i for i, n in enumerate("一二三四五六七八九十", 1)}


def prioritised_union(sources: list[tuple[str, Callable[[int], DataFrame]]], key: str, limit: int) -> tuple[DataFrame | None, list[str]]:
    """Rows of sources in order until ``limit`` distinct keys are found, and what went wrong in sources that failed.

    A source is asked for the rows that are still wanted, and not at all once there are enough. A key keeps its first
    place and its last value. Rows number ``limit`` a source at most; ``limit`` is a page of results.
    """
    parts, errors, keys = [], [], set()
    for i, (name, source) in enumerate(sources):
        needed = limit - len(keys)
        if needed <= 0:
            break
        try:
            rows = source(needed).limit(limit).withColumn("__pos", F.monotonically_increasing_id())
            rows = rows.sparkSession.createDataFrame(rows.collect(), rows.schema)
        except Exception as e:  # noqa: BLE001 - a source that fails leaves the others' rows
            errors.append(f"{name}: {str(e).splitlines()[0]}")
            continue
        keys |= {r[key] for r in rows.select(key).collect()}
        parts.append(rows.withColumn("__source", F.lit(i)))
    if not parts:
        return None, errors
    d = reduce(DataFrame.unionByName, parts)
    rest = [c for c in d.columns if not c.startswith("__")]
    at = F.struct("__source", "__pos")
    d = d.groupBy(F.col(key).alias("__key")).agg(F.min(at).alias("first"), F.max_by(F.struct(*rest), at).alias("r"))
    return d.orderBy("first").limit(limit).select("r.*"), errors


def merged_events(messages: DataFrame, ledger: DataFrame, interface: DataFrame, group: str) -> DataFrame:
    """Events of three origins (group, position, call_id, tool_name, status, payload), in order of first appearance.

    An event of a known call takes the place of the earlier one; the ledger comes after the messages, so it holds where
    both know a call. Interface events, and events without call id, are never merged. Adds ``place``, from 1 in a group.
    """
    parts = [d.withColumn("__origin", F.lit(i)) for i, d in enumerate((messages, ledger, interface))]
    d = reduce(DataFrame.unionByName, parts)
    alone = (F.col("__origin") == 2) | (F.coalesce("call_id", F.lit("")) == "")
    d = d.withColumn("__call", F.when(alone, F.concat_ws(":", F.lit("\u0000"), "__origin", "position")).otherwise(F.col("call_id")))
    at = F.struct("__origin", "position")
    rest = [c for c in messages.columns if c not in (group, "position")]
    d = d.groupBy(group, "__call").agg(F.min(at).alias("__first"), F.max_by(F.struct(*rest), at).alias("__r"))
    d = d.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("__first")))
    return d.select(group, "place", *[F.col(f"__r.{c}").alias(c) for c in rest])


def recent_distinct(df: DataFrame, group: list[str], key: str, order: str, keep: int = 30) -> DataFrame:
    """Of each group the ``keep`` keys seen last, each with its last row; a key that comes again moves to the end."""
    rest = [c for c in df.columns if c not in (*group, key)]
    d = df.where(F.col(key).isNotNull()).groupBy(*group, key).agg(F.max_by(F.struct(*rest), order).alias("__r"))
    d = d.select(*group, key, *[F.col(f"__r.{c}").alias(c) for c in rest])
    n = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(order), F.desc(key)))
    return d.withColumn("__n", n).where(F.col("__n") <= keep).drop("__n")


def chosen_places(text: Column, bare: bool = True) -> Column:
    """Places named in a text, 1 to 50, ascending, five at most: digits (``bare``: any, else before a measure word), and
    numerals up to ten before a measure word."""
    digits = F.regexp_extract_all(text, F.lit("(\\d{1,9})") if bare else F.lit("第?\\s*(\\d{1,9})\\s*(?:篇|条|个)"), 1)
    before = "第\\s*" if bare else "第?\\s*"
    spoken = F.filter(F.array(*[F.when(text.rlike(f"{before}{n}\\s*(?:篇|条|个)"), F.lit(i)) for n, i in NUMERALS.items()]), lambda x: x.isNotNull())
    every = F.concat(F.transform(digits, lambda x: x.cast("int")), spoken)
    return F.slice(F.array_sort(F.array_distinct(F.filter(every, lambda x: (x >= 1) & (x <= 50)))), 1, 5)


def at_place(selections: DataFrame, results: DataFrame, group: str, place: str = "place") -> DataFrame:
    """Chosen results by their place; ``found`` is false for places out of range."""
    d = selections.select(group, F.explode("places").alias(place)).join(results.withColumn("found", F.lit(True)), [group, place], "left")
    return d.withColumn("found", F.coalesce("found", F.lit(False)))


