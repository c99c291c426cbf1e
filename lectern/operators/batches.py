"""Greedy batches of ordered rows: a new batch starts where the next row would go over the budget.

Where a batch starts depends on where the one before did, so no window can say it. But what a range of rows does to the fill
that it starts with is a small map: a fill breaks first at the row where the running sum goes over what is left of the
budget, and from a break on, all goes the same way whatever was before. So each range is summed up by itself (for each row
that can break first: batches begun and fill at the end), the maps of a group's ranges are applied one after another, and
each range is numbered from the fill that it then starts with. One group is spread over as many tasks as it has ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.scratch import stored


class RangeMap:
    """What a run of token counts does to the fill that it starts with."""

    def __init__(self, least: np.ndarray, begun: np.ndarray, end: np.ndarray, total: int):
        self.least, self.begun, self.end, self.total = least, begun, end, total

    @classmethod
    def of(cls, tokens: np.ndarray, budget: int) -> RangeMap:
        upto = np.cumsum(tokens)
        n, before = len(tokens), np.concatenate([[0], upto[:-1]])
        follow = np.maximum(np.searchsorted(upto, budget + before, side="right"), np.arange(1, n + 1))
        # rows at which some fill breaks first: each that adds something, up to where the budget is full
        first = np.flatnonzero((tokens > 0) & (before <= budget))
        first = first if len(first) and first[0] == 0 else np.concatenate([[0], first])
        known: dict[int, tuple[int, int]] = {}
        for p in first[::-1].tolist():
            chain = []
            while p < n and p not in known:
                chain.append(p)
                p = int(follow[p])
            begun, end = known.get(p, (0, 0))
            for i, q in enumerate(reversed(chain)):
                if p >= n and i == 0:
                    end = int(upto[-1] - before[q])
                begun += 1
                known[q] = begun, end
        begun, end = zip(*(known[p] for p in first.tolist()))
        return cls(upto[first], np.array(begun), np.array(end), int(upto[-1]))

    def after(self, fill: int | None, budget: int) -> tuple[int, int]:
        """Batches begun and the fill at the end; a fill of None is before a group's first row, which begins a batch."""
        at = 0 if fill is None else int(np.searchsorted(self.least, budget - fill, side="right"))
        return (int(self.begun[at]), int(self.end[at])) if fill is None or at < len(self.least) else (0, fill + self.total)


SUMMARY = "least array<long>, begun array<long>, end array<long>, total long"


def batch_numbers(df: DataFrame, group: list[str], order: list[str], tokens: Column, budget: int = 4000, ranges: int | None = None) -> DataFrame:
    """Adds ``batch``, from 0 in each group (null is a group). A row over the budget is a batch of its own; null or negative
    counts are 0. Rows equal in group and order come in any order. Columns of ``df`` don't begin with two underscores."""
    d = df.withColumn("__tokens", F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(0)))
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # stored, since a range must be the same in both passes
    d = stored(d.repartitionByRange(n, *group, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    ordered = lambda x: x.repartition("__range").sortWithinPartitions("__range", *group, *order)
    keys = StructType([d.schema[c] for c in (*group, "__range")])
    summed = StructType([*keys, *StructType.fromDDL(SUMMARY)])
    kinds = {"least": pa.list_(pa.int64()), "begun": pa.list_(pa.int64()), "end": pa.list_(pa.int64()), "total": pa.int64()}

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, where, held = None, None, []

        def row():
            m = RangeMap.of(np.concatenate(held), budget)
            return pa.record_batch({**dict(zip(keys.names, where)), **{k: pa.array([getattr(m, k) if k == "total" else getattr(m, k).tolist()], v) for k, v in kinds.items()}})

        for b in batches:
            own = list(zip(*(b[c].to_pylist() for c in keys.names)))
            counts, at = b["__tokens"].to_numpy(), 0
            for i in [*(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]:
                if own and own[at] != key:
                    if held:
                        yield row()
                    key, where, held = own[at], [b[c].slice(at, 1) for c in keys.names], []
                held.append(counts[at:i])
                at = i
        if held:
            yield row()

    summary = ordered(d.select(*keys.names, *[c for c in order if c not in keys.names], "__tokens")).mapInArrow(sum_up, summed)
    starts = StructType([*keys, *StructType.fromDDL("__fill long, __batch long")])

    def apply_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, fill, batch = object(), None, -1
        for b in batches:
            fills, numbers = [], []
            for k, least, begun, end, total in zip(zip(*(b[c].to_pylist() for c in group)) if group else [()] * b.num_rows, *(b[c].to_pylist() for c in kinds)):
                if k != current:
                    current, fill, batch = k, None, -1
                fills.append(fill)
                numbers.append(batch)
                more, fill = RangeMap(np.array(least), np.array(begun), np.array(end), total).after(fill, budget)
                batch += more
            yield pa.record_batch({**{c: b[c] for c in keys.names}, "__fill": pa.array(fills, pa.int64()), "__batch": pa.array(numbers, pa.int64())})

    # one row a range and group: a group has as many as there are ranges
    summary = (summary.repartition(*group) if group else summary.repartition(1)).sortWithinPartitions(*group, "__range")
    starts_df = summary.mapInArrow(apply_maps, starts)
    names = [c for c in d.columns if c not in ("__tokens", "__range")]
    on = F.lit(True)
    for c in keys.names:
        on = on & F.col(f"d.`{c}`").eqNullSafe(F.col(f"s.`{c}`"))
    d = d.alias("d").join(starts_df.alias("s"), on).select(*[F.col(f"d.`{c}`") for c in d.columns], "__fill", "__batch")
    out = StructType([*[d.schema[c] for c in names], *StructType.fromDDL("batch long")])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, fill, batch = object(), None, 0
        for b in batches:
            got = []
            for k, t, f, start in zip(zip(*(b[c].to_pylist() for c in keys.names)), *(b[c].to_pylist() for c in ("__tokens", "__fill", "__batch"))):
                if k != current:
                    current, fill, batch = k, f, start
                if fill is None or fill + t > budget:
                    batch, fill = batch + 1, t
                else:
                    fill += t
                got.append(batch)
            yield pa.record_batch({**{c: b[c] for c in names}, "batch": pa.array(got, pa.int64())})

    return ordered(d).mapInArrow(number, out)


def batched(df: DataFrame, group: list[str], order: str, key: str, tokens: Column, budget: int = 4000) -> DataFrame:
    """(*group, batch, ids): greedy batches of each group, ``ids`` being the texts of ``key`` in order."""
    d = df.select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)], F.col(order).alias("o"), F.col(key).alias("k"), tokens.cast("long").alias("t"))
    d = batch_numbers(d, [f"g{i}" for i in range(len(group))], ["o", "k", "t"], F.col("t"), budget)
    d = d.groupBy(*[f"g{i}" for i in range(len(group))], "batch").agg(F.sort_array(F.collect_list(F.struct("o", "k", "t"))).alias("rows"))
    return d.select(*[F.col(f"g{i}").alias(c) for i, c in enumerate(group)], F.col("batch").cast("int").alias("batch"), F.transform("rows", lambda r: r["k"].cast("string")).alias("ids"))
