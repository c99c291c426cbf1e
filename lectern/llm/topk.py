"""Exact top-k inner products: a ball tree in each shard, searched by branch and bound.

Vectors are dealt to shards of bounded size by a hash; queries come in blocks of bounded size, large ones, since each
block sends every vector once. A task holds one shard and one block of queries, builds the shard's ball tree and visits
its nodes, for each query the child of the larger bound first; a node whose bound |q| r + q.c lies below the query's kth
score is passed over. The first eighth of the shards is searched first, and the kth scores it gives are handed to all
other shards, so that these start with a bound close to the true one. Bounds are never rounded down and only strictly
lower nodes are passed over, hence ties are exact. Products are of whole numbers: in doubles where these hold them, else
in 64-bit integers, else in Python's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shuffle_partitions, table, written

SHARD_ROWS, QUERY_ROWS, LEAF = 65_536, 32_768, 128
SCALE, MOST, LONG = 1024, 1.7976931348623157e308, (1 << 63) - 1


def whole_vector(v: Column) -> Column:
    """floor(1024 x) of each component, as doubles that hold whole numbers; null where a component is null or not finite.

    From 2**52 on a double is whole by itself; where 1024 x is more than a double holds, it is the largest double.
    """
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))

    def whole(x: Column) -> Column:
        y = x.cast("double") * SCALE
        return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), y)))

    return F.when(fit, F.transform(v, whole))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros to ``width``."""
    c = column.combine_chunks()
    c = c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)
    n = pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(c), width), np.float64)
    row = np.repeat(np.arange(len(c)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = c.flatten().to_numpy(zero_copy_only=False)
    return out


class BallTree:
    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids, self.nodes = x.copy(), ids.copy(), []
        self.largest = float(np.abs(x).max(initial=0))
        self.huge = self.largest > 1e75  # squares of products would leave the doubles: no bounds, all are looked at
        if len(x) and not self.huge:
            self._build(0, len(x))

    def _build(self, lo: int, hi: int) -> int:
        x = self.x[lo:hi]
        center = x.mean(0)
        radius = float(np.sqrt(((x - center) ** 2).sum(1).max()))
        at = len(self.nodes)
        self.nodes.append([center, radius * (1 + 1e-9), lo, hi, -1, -1])
        if hi - lo > LEAF and radius > 0:
            # the axis between two far points
            far = x[((x - center) ** 2).sum(1).argmax()]
            other = x[((x - far) ** 2).sum(1).argmax()]
            order = np.argsort(x @ (other - far), kind="stable")
            self.x[lo:hi], self.ids[lo:hi] = x[order], self.ids[lo:hi][order]
            mid = (lo + hi) // 2
            self.nodes[at][4], self.nodes[at][5] = self._build(lo, mid), self._build(mid, hi)
        return at

    def search(self, q: np.ndarray, own: np.ndarray, k: int, kth: list) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), k columns, best first; ``none`` where there are fewer. Scores under ``kth`` (or None) may be left out."""
        most = float(np.abs(q).max(initial=0)) * self.largest * q.shape[1]
        self.kind = np.float64 if most < 2**53 else np.int64 if most < 2**62 else object
        self.none = -np.inf if self.kind is np.float64 else np.iinfo(np.int64).min if self.kind is np.int64 else -(1 << 4200)
        whole = (lambda x: x) if self.kind is np.float64 else (lambda x: x.astype(np.int64)) if self.kind is np.int64 else (lambda x: np.array([[int(c) for c in r] for r in x], object).reshape(x.shape))
        self.q, self.own, self.q_whole, self.x_whole = q, own, whole(q), whole(self.x)
        self.kth = np.array([self.none if t is None else t for t in kth], self.kind)
        self.best = np.full((len(q), k), self.none, self.kind)
        self.best_ids = np.full((len(q), k), np.iinfo(np.int64).max)
        if len(q) and self.huge or (len(q) and self.nodes and float(np.abs(q).max()) > 1e75):
            self._leaf(np.arange(len(q)), 0, len(self.x))
        elif self.nodes and len(q):
            self.norm = np.sqrt((q**2).sum(1)) * (1 + 1e-9)
            self._visit(0, np.arange(len(q)))
        return self.best, self.best_ids

    def _bound(self, node: int, rows: np.ndarray) -> np.ndarray:
        center, radius = self.nodes[node][:2]
        return self.q[rows] @ center + self.norm[rows] * radius + 1e-6 * (1 + self.norm[rows] * np.sqrt((center**2).sum()))

    def _visit(self, node: int, rows: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            rows = rows[self._bound(node, rows) >= self.kth[rows].astype(np.float64) if self.kind is not object else [b >= t for b, t in zip(self._bound(node, rows).tolist(), self.kth[rows])]]
        if not len(rows):
            return
        _, _, lo, hi, left, right = self.nodes[node]
        if left < 0:
            return self._leaf(rows, lo, hi)
        first = self._bound(left, rows) >= self._bound(right, rows)
        for part, order in ((rows[first], (left, right)), (rows[~first], (right, left))):
            if len(part):
                for child in order:
                    self._visit(child, part)

    def _leaf(self, rows: np.ndarray, lo: int, hi: int) -> None:
        for a in range(lo, hi, 1024):  # a leaf of equal vectors can be long
            x, ids = self.x_whole[a:min(hi, a + 1024)], self.ids[a:min(hi, a + 1024)]
            s = self.q_whole[rows] @ x.T
            s[self.own[rows][:, None] == ids[None, :]] = self.none
            new = np.asarray(s.max(1) >= self.kth[rows], bool)
            r = rows[new]
            if len(r):
                score = np.concatenate([self.best[r], s[new]], 1)
                name = np.concatenate([self.best_ids[r], np.broadcast_to(ids, (len(r), len(ids)))], 1)
                name = np.where(np.asarray(score == self.none, bool), np.iinfo(np.int64).max, name)
                order = np.argsort(name, axis=1, kind="stable")
                by = np.take_along_axis(score, order, 1)
                order = np.take_along_axis(order, np.argsort(-by if self.kind is not np.int64 else ~by, axis=1, kind="stable"), 1)[:, : self.best.shape[1]]
                self.best[r], self.best_ids[r] = np.take_along_axis(score, order, 1), np.take_along_axis(name, order, 1)
                self.kth[r] = np.maximum(self.kth[r], self.best[r, -1])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``vectors`` (vec_id, v) for each row of ``queries`` (vec_id, v).

    ``v`` is an array of whole doubles, not null; a shorter vector counts as filled up with zeros. Rows of one id are rows
    of their own on both sides, but no row of a query's own id is its candidate. Ties go to the smaller id. Order is by
    the exact score; one that a long can't hold is given as the largest or least long. An empty side gives an empty
    table; other columns don't matter.
    """
    spark = vectors.sparkSession
    n, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_queries, q_width = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(width, q_width, 1)
    n_shards = max(1, -(-n // SHARD_ROWS), min(shuffle_partitions(spark), n // 1024))
    n_blocks = max(1, -(-n_queries // QUERY_ROWS))
    first = -(-n_shards // 8)
    v = vectors.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("part"))
    # rows of one id and vector ask the same, and are answered as one; ``times`` gives each its rows again
    q = queries.groupBy(F.col("vec_id").alias("asked_id"), F.col("v").alias("asked_v")).agg(F.count(F.lit(1)).alias("times"))
    q = q.withColumn("asked", F.xxhash64("asked_id", "asked_v")).withColumn("part", F.pmod("asked", F.lit(n_blocks)).cast("int"))

    def search(t: pa.Table, asked: pa.Table) -> pa.Table:
        ids = t["vec_id"].to_numpy()
        x = matrix(t["v"], width) if len(ids) else np.zeros((0, width))
        if len(ids):  # of equal vectors, only rows of the k + 1 smallest ids, k of each, can be among a query's k best
            order = np.lexsort((ids, *x.T))
            x, ids = x[order], ids[order]
            new = np.r_[True, (x[1:] != x[:-1]).any(1)]
            other = new | np.r_[True, ids[1:] != ids[:-1]]
            nth = np.cumsum(other)
            nth -= nth[np.flatnonzero(new)][np.cumsum(new) - 1]
            again = np.arange(len(ids)) - np.flatnonzero(other)[np.cumsum(other) - 1]
            keep = (nth <= k) & (again < k)
            x, ids = x[keep], ids[keep]
        own = asked["asked_id"].to_numpy()
        q = matrix(asked["asked_v"], width) if len(own) else np.zeros((0, width))
        tree = BallTree(x, ids)
        score, name = tree.search(q, own, k, [None if t is None or abs(t) >= LONG else t for t in asked["kth"].to_pylist()])
        row, col = np.nonzero(np.asarray(score != tree.none, bool))
        return pa.table({
            "asked": asked["asked"].to_numpy()[row], "query_id": own[row], "vec_id": name[row, col],
            "score": pa.array([str(int(s)) for s in score[row, col]] if tree.kind is object else score[row, col].astype(np.int64).astype(str), pa.string()),
            "times": asked["times"].to_numpy()[row],
        }, schema=FOUND)

    def run(lo: int, hi: int, queries_: DataFrame) -> DataFrame:
        spread = queries_.withColumn("shard", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))))
        got = v.where((F.col("shard") >= lo) & (F.col("shard") < hi)).groupBy("shard", "part").cogroup(spread.groupBy("shard", "part")).applyInArrow(search, "asked long, query_id long, vec_id long, score string, times long")
        # digits and sign order as the numbers do
        digits = F.length(F.regexp_replace("score", "-", ""))
        return got.withColumn("order", F.when(F.col("score").startswith("-"), F.struct((-digits).alias("n"), F.translate("score", "0123456789", "9876543210").alias("d"))).otherwise(F.struct(digits.alias("n"), F.col("score").alias("d"))))

    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("order"), "vec_id"))

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    held = F.coalesce(F.col("score").try_cast("long"), F.when(F.col("score").startswith("-"), F.lit(-LONG - 1)).otherwise(F.lit(LONG)))
    found = best(run(0, first, q.withColumn("kth", F.lit(None).cast("long"))))
    if first < n_shards:
        found = written(found, "first")
        bound = found.where(F.col("rank") == k).select("asked", held.alias("kth"))
        found = best(found.drop("rank").union(run(first, n_shards, q.join(bound, "asked", "left"))))
    found = found.withColumn("__again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", held.alias("score"))


FOUND = pa.schema([("asked", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.string()), ("times", pa.int64())])


def whole_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part: id and vector not null, all components finite. Every row counts, those of
    one id too. Vectors of no component stay, with score 0."""
    d = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), whole_vector(F.col(f"`{vector_col}`")).alias("v"))
    return d.where("vec_id is not null and v is not null")


def op5_ball_tree_topk(spark, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector with all others."""
    v = written(whole_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(v, v.where("vec_id % 100 = 0"), 10)


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
