"""Sharding by a k-d tree over metadata, with DataFrame functions alone.

Documents of equal text form one group, which is never split. Starting from all groups, a node that must give m
shards is cut along its widest dimension (its range as a share of the dimension's range over all data) at the
weighted quantile that puts floor(m / 2) / m of its bytes on the left, until every node is one shard. Quantiles are
distributed: each pass sums the weights in bins of the interval still open, and only these sums, a bounded number
for all nodes together, reach the driver, which narrows the interval. Where one value of the dimension holds more
than the cut allows (a source with a third of all rows), the groups of that value are cut by a hash of the group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import numbered, table, written

#: Bins of one pass, for all nodes together.
BINS = 8192


MOST = (1 << 63) - 1


@dataclass
class Cut:
    """The search for one node's cut: rows below (value, tie) go left."""

    node: int
    dim: int
    lo: int
    hi: int  # inclusive
    want: float
    below: float = 0.0
    value: int | None = None  # set once the search is inside one value, over ties
    done: tuple[int, int] | None = None


def _rows(spark: SparkSession, names: dict[str, str], rows: list[tuple]) -> DataFrame:
    """A small table of whole numbers that is part of the plan; it has a row for each node in question."""
    cell = lambda x, kind: f"CAST({'NULL' if x is None else repr(str(x))} AS {kind})"
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(cell(x, k) for x, k in zip(r, names.values())) + ')' for r in rows)} AS t({', '.join(names)})")


def kd_shards(groups: DataFrame, dims: list[str], weight: str, tie: str, n_shards: int) -> DataFrame:
    """Adds ``shard`` (0 to n_shards - 1) to ``groups``, whose dims are longs and not null, and tie a long hash >= 0."""
    spark = groups.sparkSession
    level = written(groups.withColumn("__node", F.lit(0)), "kd")
    ranges = level.agg(*[f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]).first()
    whole = [max(1, (ranges[f"max_{d}"] or 0) - (ranges[f"min_{d}"] or 0)) for d in dims]
    shards = {0: (0, n_shards)}  # node -> first shard, number of shards
    next_node = 1
    while any(m > 1 for _, m in shards.values()):
        stats = level.groupBy("__node").agg(F.sum(weight).alias("w"), *[f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]).collect()
        cuts = []
        for r in stats:
            first, m = shards[r["__node"]]
            if m > 1:
                width = [(r[f"max_{d}"] - r[f"min_{d}"]) / whole[i] for i, d in enumerate(dims)]
                dim = width.index(max(width))
                cuts.append(Cut(r["__node"], dim, r[f"min_{dims[dim]}"], r[f"max_{dims[dim]}"], float(r["w"]) * (m // 2) / m))
        if not cuts:
            break
        tolerance = {c.node: c.want / 2000 for c in cuts}
        while open_ := [c for c in cuts if c.done is None]:
            for i in range(0, len(open_), BINS // 8):
                _narrow(level, dims, weight, tie, open_[i:i + BINS // 8], tolerance)
        rows, grown = [], {}
        for c in cuts:
            first, m = shards[c.node]
            rows.append((c.node, c.dim, *(c.done if c.done[0] <= MOST else (MOST, 1 << 62)), next_node, next_node + 1))
            grown[next_node], grown[next_node + 1] = (first, m // 2), (first + m // 2, m - m // 2)
            next_node += 2
        shards = {n: s for n, s in shards.items() if s[1] == 1} | grown
        split = _rows(spark, {"__node": "INT", "__dim": "INT", "__cut": "BIGINT", "__tie": "BIGINT", "__left": "INT", "__right": "INT"}, rows)
        v = F.get(F.array(*dims), F.col("__dim"))
        left = (v < F.col("__cut")) | ((v == F.col("__cut")) & (F.col(tie) < F.col("__tie")))
        level = level.join(split, "__node", "left").withColumn("__node", F.when(F.col("__dim").isNull(), F.col("__node")).otherwise(F.when(left, F.col("__left")).otherwise(F.col("__right"))))
        level = written(level.select(*groups.columns, "__node"), "kd")
    named = _rows(spark, {"__node": "INT", "shard": "INT"}, [(n, first) for n, (first, _) in shards.items()])
    return level.join(named, "__node").drop("__node")


def _narrow(level: DataFrame, dims: list[str], weight: str, tie: str, cuts: list[Cut], tolerance: dict[int, float]) -> None:
    """One pass over the data: every open search moves into the bin that holds its quantile, or ends. Bins are at most BINS."""
    bins = BINS // len(cuts)
    step = {c.node: -(-(c.hi - c.lo + 1) // bins) for c in cuts}
    wide = "DECIMAL(21,0)"  # the whole range of a long, and its width, fit
    open_ = _rows(level.sparkSession, {"__node": "INT", "__dim": "INT", "__lo": wide, "__hi": wide, "__step": wide, "__value": "BIGINT"}, [(c.node, c.dim, c.lo, c.hi, step[c.node], c.value) for c in cuts])
    v: Column = F.get(F.array(*dims), F.col("__dim"))
    inside = F.col("__value").isNull() | (v == F.col("__value"))
    at = F.when(F.col("__value").isNull(), v).otherwise(F.col(tie)).cast("decimal(20,0)")
    d = level.join(open_, "__node").where(inside).withColumn("__at", at).where("__at >= __lo and __at <= __hi")
    found: dict[int, dict[int, float]] = {c.node: {} for c in cuts}
    for r in d.groupBy("__node", F.expr("(__at - __lo) div __step").alias("b")).agg(F.sum(weight).alias("w")).collect():
        found[r["__node"]][r["b"]] = float(r["w"])
    for c in cuts:
        total, lo, width, w = c.below, c.hi + 1, step[c.node], 0.0
        for b in sorted(found[c.node]):
            w, lo = found[c.node][b], c.lo + b * width
            if total + w >= c.want:
                break
            total += w
        else:
            w, lo = 0.0, c.hi + 1
        c.below = total
        if w <= tolerance[c.node] or (width == 1 and c.value is not None):
            edge = lo if c.want - total < total + w - c.want else min(lo + width, c.hi + 1)
            c.done = (edge, 0) if c.value is None else (c.value, edge)
        elif width == 1:
            c.value, c.lo, c.hi = lo, 0, (1 << 62) - 1
        else:
            c.lo, c.hi = lo, min(lo + width - 1, c.hi)


def shard_documents(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(id, size, text_crc32, shard, slot): one row for each row of ``docs``.

    ``n_shards``, or as many shards as leave none over about ``target_bytes``. Dimensions of the tree: the smallest id of
    a group, its text's bytes, and a hash of each ``metadata`` column that ``docs`` has. Sizes differ by about a
    thousandth, or by one group of equal texts if that is more; a group larger than a shard makes a larger shard.

    Null text counts as empty (size 1), in one group with empty texts. Null ids and metadata sort first. Equal rows get
    slots of their own. An empty table gives an empty table; other columns don't matter.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    has = [m for m in metadata if m in docs.columns and m not in (id_col, text_col)]
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("grp"), *[F.crc32(F.coalesce(F.col(f"`{m}`").cast("string"), F.lit("")).cast("binary")).alias(f"m{i}") for i, m in enumerate(has)],
    )
    rows = written(rows, "rows")
    dims = ["d_id", "d_size", *[f"d_m{i}" for i in range(len(has))]]
    groups = rows.groupBy("grp").agg(
        F.sum("size").alias("weight"), F.coalesce(F.min("id"), F.lit(-(1 << 63) + 1).cast("long")).alias("d_id"), F.min("size").alias("d_size"),
        *[F.min(f"m{i}").alias(f"d_m{i}") for i in range(len(has))],
    ).withColumn("tie", F.shiftrightunsigned(F.xxhash64("grp"), 2))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if n_shards is None:
        n_shards = max(1, -(-total[0] // (target_bytes or total[0] or 1)))
    placed = kd_shards(groups, dims, "weight", "tie", n_shards).select("grp", "shard")
    out = rows.join(placed, "grp").select("id", "size", "text_crc32", "shard")
    chunks = max(16, total[1] // 20_000)
    return numbered(out, ["shard"], [F.col("id"), F.col("text_crc32")], F.pmod(F.xxhash64("id", "text_crc32"), F.lit(chunks)), "slot")


def op2_kd_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes; equal texts together."""
    out = shard_documents(table(spark, sf_dir, "documents"), n_shards=8)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
