"""Keyed tables and logs: deduplication that minds order, upserts, latest rows, versions, audits and mined patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.scratch import stored


def first_position_last_value(df: DataFrame, key: list[str], order: str, values: list[str]) -> DataFrame:
    """One row a key: the place where the key first stands, the values that it has last. Partial aggregates, no sort."""
    return df.groupBy(*key).agg(F.min(order).alias("first_position"), *[F.max_by(v, order).alias(v) for v in values])


def first_wins(df: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def latest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key, by a partial maximum."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert(base: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """``base`` with the rows of ``delta`` in place of those of the same key. Keys in ``delta`` are distinct."""
    return base.join(delta.select(*key), key, "left_anti").unionByName(delta)


def replace_all(base: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """All rows of the keys in ``delta`` go, and its rows come in their place."""
    return base.join(delta.select(*key).distinct(), key, "left_anti").unionByName(delta)


def numbered(df: DataFrame, key: list[str], order: str, out: str, total: str | None = None) -> DataFrame:
    """Adds ``out``: 1, 2, 3 … of each key in order, and the key's rows as ``total``; rows equal in both get their places by chance.

    Rows are numbered inside ranges of (key, order) that are alike in size, and the ranges' counts give each its first number,
    so a key with very many rows is spread over tasks. Keys are not null; nulls in the order come first.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(n, *key, order, "__tie").withColumn("__range", F.spark_partition_id())
    d = stored(d, "ranges")  # a row must stay in its range
    n = d.groupBy(*key, "__range").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*key)
    n = n.withColumn("__before", F.sum("__n").over(w.orderBy("__range")) - F.col("__n")).withColumn("__all", F.sum("__n").over(w)).drop("__n")
    d = d.withColumn("__i", F.row_number().over(Window.partitionBy(*key, "__range").orderBy(order, "__tie"))).join(n, [*key, "__range"])
    d = d.withColumn(out, (F.col("__before") + F.col("__i")).cast("long"))
    return d.select(*df.columns, out, *([F.col("__all").alias(total)] if total else []))


def head_and_tail(df: DataFrame, key: list[str], order: str, head: int, tail: int) -> DataFrame:
    """Adds ``part``: head, middle or tail of each key's sequence."""
    d = numbered(df, key, order, "__at", total="__rows")
    part = F.when(F.col("__at") <= head, "head").when(F.col("__at") > F.col("__rows") - tail, "tail").otherwise("middle")
    return d.select(*df.columns, part.alias("part"))


def citation_audit(citations: DataFrame, pool: DataFrame, key: str = "ref") -> DataFrame:
    """For each document (doc, ref): references, those not in the pool, and whether all are valid."""
    known = pool.select(key).distinct().withColumn("__known", F.lit(1))
    d = citations.join(known, key, "left").groupBy("doc").agg(F.count(F.lit(1)).alias("n_cited"), F.count_if(F.col("__known").isNull()).alias("n_hallucinated"))
    return d.withColumn("is_valid", F.col("n_hallucinated") == 0)


def mined_patterns(events: DataFrame, signature: list[str], success: Column, least: int, rate: float) -> DataFrame:
    """Signatures with enough successes and a high enough success rate."""
    d = events.groupBy(*signature).agg(F.count_if(success).alias("successes"), F.count_if(~success).alias("failures"))
    d = d.withColumn("success_rate", F.round(F.col("successes") / (F.col("successes") + F.col("failures")), 4))
    return d.where((F.col("successes") >= least) & (F.col("success_rate") >= rate))


def coverage(citations: DataFrame, pool: DataFrame, key: str = "ref") -> DataFrame:
    """How many of the pool's distinct keys are cited, and their share; 0 for an empty pool."""
    cited = citations.select(key).distinct().withColumn("__cited", F.lit(1))
    d = pool.select(key).distinct().join(cited, key, "left").agg(F.count(F.lit(1)).alias("n_pool"), F.count("__cited").alias("n_covered"))
    return d.withColumn("coverage", F.when(F.col("n_pool") > 0, F.round(F.col("n_covered") / F.col("n_pool"), 4)).otherwise(0.0))


def changes(old: DataFrame, new: DataFrame, key: str, mark: str) -> DataFrame:
    """Keys that were added, removed or whose ``mark`` is another; keys are distinct in each table and marks not null."""
    d = old.select(key, F.col(mark).alias("__old")).join(new.select(key, F.col(mark).alias("__new")), key, "full_outer")
    kind = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") != F.col("__new"), "updated")
    return d.select(key, kind.alias("change")).where("change is not null")
