"""What several operators share: the scratch folder, whole-table numbering, links to components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are what stands between these characters: the blank and U+0009 to U+000D.
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"

_OWN_SCRATCH: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; one of this process's own only where that is unset and the master local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_SCRATCH:
        _OWN_SCRATCH.append("file://" + tempfile.mkdtemp(prefix="spark-scratch-"))
    return _OWN_SCRATCH[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the scratch folder: cuts the lineage, and outlives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def numbered(df: DataFrame, group: list[str], order: list[Column], chunk: Column, out: str) -> DataFrame:
    """Adds ``out``: 0, 1, 2 … without gaps inside each ``group``, in the order (chunk, *order).

    No group meets in one task: rows are numbered inside (group, chunk), and the chunks' counts give each
    chunk its first number. ``chunk`` must spread the rows evenly and have a bounded number of values; only
    one count per (group, chunk) goes through the second window.
    """
    from pyspark.sql import Window

    d = df.withColumn("__chunk", chunk)
    local = Window.partitionBy(*group, "__chunk").orderBy(*order)
    counts = d.groupBy(*group, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    on = reduce(lambda a, b: a & b, [F.col(f"d.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (*group, "__chunk")])
    d = d.withColumn("__local", F.row_number().over(local))
    return (
        d.alias("d").join(first.alias("f"), on)
        .select(*[F.col(f"d.`{c}`") for c in df.columns], (F.col("f.__first") + F.col("d.__local") - 1).cast("long").alias(out))
    )


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links' nodes, each linked to the least node that it reaches by these links alone."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a):]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for x in (u, v, label[u], label[v]):
            np.minimum.at(new, x, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            far = label != np.arange(len(ids))
            return ids[far], ids[label[far]]
        label = new


def _contracted(links: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Links (a, b) with the same components: those that lie together in a partition become stars, a bounded number at a time."""

    def contract(batches):
        held, n = [], 0
        for t in batches:
            held.append(t)
            n += t.num_rows
            if n >= rows:
                yield star(held)
                held, n = [], 0
        if held:
            yield star(held)

    def star(held: list) -> pa.RecordBatch:
        a, b = _forest(*(np.concatenate([t[c].to_numpy() for t in held]) for c in ("a", "b")))
        return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links.mapInArrow(contract, "a long, b long")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for the nodes of undirected ``links`` (a, b; longs), component being the smallest node reached.

    Alternating large-star and small-star rounds, each a pre-aggregated minimum and a join, written to the scratch
    folder; links that lie in one partition are contracted there first, so few rounds are left for the shuffles. A node
    with very many links is split by the skew join; links never meet on the driver.
    """
    edges = written(_contracted(links.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b")), name)
    last = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour of a node joins the least node in sight
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(_contracted(large.where("a <> b")).distinct(), name)
        # small star: the node and its smaller neighbours join the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = written(_contracted(small.where("a <> b")).distinct(), name)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
