"""Packing into optimal length buckets: dynamic programming over the global histogram of lengths.

Lengths are counted by Spark, one bin for each distinct length; texts of t words in all have under sqrt(2 t) of these.
The least total padding with at most ``n_buckets`` boundaries is found exactly, in whole numbers: the best start of a
bucket never falls as its end grows, so each row of the programme is divided and conquered. Boundaries are lengths that
occur. Inside a bucket, documents are numbered without any group meeting in one task, and every
``token_budget // boundary`` of them (one at least) form a batch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import numbered, table, written

def n_words(text: Column) -> Column:
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.regexp_count(t, F.lit("[^\\x20\\x09-\\x0D]+"))


def optimal_boundaries(longest: np.ndarray, rows: np.ndarray, tokens: np.ndarray, n_buckets: int) -> list[int]:
    """Boundaries, ascending, that minimise padding: bins are in order of length, ``longest`` the longest of each."""
    n = len(longest)
    if not n:
        return []
    kind = np.int64 if int(longest[-1]) * sum(rows.tolist()) < 1 << 62 else object  # Python's whole numbers where 64 bits are few
    longest = longest.astype(kind)
    count, total = (np.concatenate([[0], np.cumsum(x.astype(kind))]).astype(kind) for x in (rows, tokens))
    best = longest * count[1:] - total[1:]  # one bucket over bins 0 .. j
    come = [np.zeros(n, np.int64)]
    for _ in range(min(n_buckets, n) - 1):
        now, start = best.copy(), np.full(n, -1)
        # ends lo .. hi have starts a .. b; all ranges of a depth at once
        lo, hi, a, b = (np.array([x]) for x in (1, n - 1, 1, n - 1))
        while len(lo):
            mid = (lo + hi) // 2
            many = np.minimum(mid, b) - a + 1
            first = np.cumsum(many) - many
            part = np.repeat(np.arange(len(mid)), many)
            i, j = (a - first)[part] + np.arange(len(part)), mid[part]
            cost = best[i - 1] + longest[j] * (count[j + 1] - count[i]) - (total[j + 1] - total[i])
            least = np.minimum.reduceat(cost, first)
            hit = np.flatnonzero(cost == least[part])
            at = i[hit[np.unique(part[hit], return_index=True)[1]]]
            gain = (least < now[mid]).astype(bool)
            now[mid[gain]], start[mid[gain]] = least[gain], at[gain]
            lo, hi, a, b = np.r_[lo, mid + 1], np.r_[mid - 1, hi], np.r_[a, at], np.r_[at, b]
            some = lo <= hi
            lo, hi, a, b = lo[some], hi[some], a[some], b[some]
        best = now
        come.append(start)
    out, j, level = [], n - 1, len(come) - 1
    while j >= 0:
        while level and come[level][j] < 0:  # no gain from this many buckets
            level -= 1
        out.append(int(longest[j]))
        j = int(come[level][j]) - 1
        level = max(0, level - 1)
    return out[::-1]


def packed(docs: DataFrame, n_buckets: int = 16, token_budget: int = 65_536, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None) -> DataFrame:
    """(id, n_tokens, bucket, boundary, batch, position, padding): one row for each row of ``docs``.

    A document's length is ``length``, or its number of words and one end. Null and empty texts have length 1. A
    document longer than the budget is a batch of its own and stays whole. Equal rows get places of their own, null
    ids come first, ties in length share a bucket. An empty table gives an empty table; other columns don't matter.
    """
    n_tokens = (n_words(F.col(f"`{text_col}`")) + 1 if length is None else length).cast("long")
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), n_tokens.alias("n_tokens"), F.xxhash64(f"`{text_col}`").alias("__tie"))
    d = written(d, "lengths")
    bins = d.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("rows")).collect()
    bins.sort(key=lambda r: r["n_tokens"])
    longest, rows = (np.array([r[c] for r in bins], np.int64) for c in ("n_tokens", "rows"))
    edges = optimal_boundaries(longest, rows, longest * rows, n_buckets) or [1]
    bucket = F.lit(0)
    for i, edge in enumerate(edges[:-1]):
        bucket = F.when(F.col("n_tokens") > edge, F.lit(i + 1)).otherwise(bucket)
    d = d.withColumn("bucket", bucket.cast("int"))
    d = d.withColumn("boundary", F.element_at(F.lit(edges).cast("array<long>"), F.col("bucket") + 1))
    total = sum(r["rows"] for r in bins)
    chunk = F.pmod(F.xxhash64("id", "__tie"), F.lit(max(16, total // 20_000)))
    d = numbered(d, ["bucket"], [F.col("id"), F.col("__tie")], chunk, "__slot")
    per = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("boundary")))
    return d.select(
        "id", "n_tokens", "bucket", "boundary", F.floor(F.col("__slot") / per).cast("long").alias("batch"), F.pmod(F.col("__slot"), per).cast("long").alias("position"),
        (F.col("boundary") - F.col("n_tokens")).cast("long").alias("padding"),
    )


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in optimal length buckets and batches of a token budget."""
    return packed(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
