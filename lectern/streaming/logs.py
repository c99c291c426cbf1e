"""Event logs: admission by a sliding window for each key, and hourly counts kept up to date by a stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType


def rate_limited(log: DataFrame, key: str, seconds: Column, order: list[str], limit: int = 20, window: float = 3600.0) -> DataFrame:
    """Adds ``allowed``: whether fewer than ``limit`` admitted rows of the key lie within ``window`` seconds before.

    Refused rows don't count, so a row depends on the answers before it and no frame of a window can say it. Rows
    are dealt by key and sorted, and pass through a task in batches; what is kept is ``limit`` times of one key.
    Rows with null key or time are refused.
    """
    names = log.columns
    d = log.withColumn("__at", seconds.cast("double")).repartition(F.col(key)).sortWithinPartitions(key, "__at", *order)

    def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kept = None, deque()
        for b in batches:
            out = []
            for k, at in zip(b[key].to_pylist(), b["__at"].to_pylist()):
                if k is None or at is None or at != at:
                    out.append(False)
                    continue
                if k != current:
                    current, kept = k, deque()
                while kept and kept[0] < at - window:
                    kept.popleft()
                out.append(len(kept) < limit)
                if out[-1]:
                    kept.append(at)
            yield pa.record_batch({**{c: b[c] for c in names}, "allowed": pa.array(out, pa.bool_())})

    return d.mapInArrow(admit, StructType([*log.schema, StructField("allowed", BooleanType())]))


def hourly(events: DataFrame, time: str, *keys: str, late: str = "2 hours") -> DataFrame:
    """Rows by hour and keys, for a table or a stream; a stream passes over rows that are ``late`` behind, and keeps no
    hours that none can come for any more."""
    d = events.withColumn("__t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        d = d.withWatermark("__t", late)
    out = d.groupBy(F.window("__t", "1 hour"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), *keys, "n")


def streamed(events: DataFrame, folder: str, to_rows, key: list[str]) -> DataFrame:
    """What ``to_rows`` gives for the stream ``events``, run until its source has no more: the newest row of each key.

    Each batch appends the rows it has changed under its own number, so a batch that runs again replaces its own rows and
    no others. The checkpoint lies in the same shared folder, and a later run goes on where the last one ended.
    """
    shape = to_rows(events)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = shape.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = events.sparkSession
    spark.createDataFrame([], shape.schema).write.mode("overwrite").parquet(f"{folder}/rows/batch=-1")  # a stream without rows has none else
    columns = shape.columns
    rows = spark.read.schema(StructType([*shape.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/rows")
    rest = [c for c in columns if c not in key]
    d = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return d.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def drained(rows: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that the stream ``rows`` gives until its source has no more, with ``batch``, the number of the micro-batch.

    A batch that runs again replaces its own rows; the checkpoint lies in the same shared folder.
    """
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = rows.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = rows.sparkSession
    spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{folder}/rows/batch=-1")  # a stream without rows has none else
    return spark.read.schema(StructType([*rows.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/rows").where("batch >= 0")
