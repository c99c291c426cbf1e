"""Tables that a job keeps between its steps, and tables that are replaced as a whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; in a folder of this process only under a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="spark-scratch-"))
        base = _OWN[0]
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the scratch folder: worked out once, and safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions under ``path`` that were written to the end."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath() for s in fs.listStatus(root)]
    return sorted(int(p.getName()[1:]) for p in names if p.getName()[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def write_version(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> int:
    """Writes ``df`` as the next version of the table at ``path``, in a folder for each value of ``by`` where that is given.

    Reads that name such a value then open its folder alone; values are texts, and an empty text comes back as null.

    Readers go on with the version before until the last file is in place, so a write that fails midway changes nothing,
    and a table may be written from what it held.
    """
    version = max(_versions(df.sparkSession, path), default=0) + 1
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/v{version}")
    return version


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest whole version of the table at ``path``, or an older one."""
    found = _versions(spark, path)
    if version not in found and (version is not None or not found):
        raise ValueError(f"no whole version {version or ''} under {path}")
    kinds = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(kinds)
    spark.conf.set(kinds, "false")  # a tenant 007 isn't 7
    try:
        return spark.read.parquet(f"{path}/v{version or found[-1]}")
    finally:
        spark.conf.set(kinds, before)
