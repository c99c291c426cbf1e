"""Names that are most like an unknown one, by matching blocks: two times the matched characters over both lengths.

Matched characters are at most those that two names have in common as bags, so an index of bags bounds the ratio from above:
of each name's k-th ``a``, k-th ``b`` … the index knows the places in the block. One pass over a name's entries counts the
common characters with every name of the block; only names whose bound can still enter the best few get the exact ratio.

Names are dealt to tasks by (group, block of the pool, block of the unknown), so a group of any size is spread, the pool is
copied once for each block of unknown names and not for each of them, and a task gives a few rows for each unknown name.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK = 4096


@lru_cache(1 << 17)
def ratio(a: str, b: str) -> float:
    """What ``SequenceMatcher(None, a, b).ratio()`` gives. Pools share much of their words, so pairs are kept."""
    if len(b) >= 200:  # its rule for very frequent characters
        return SequenceMatcher(None, a, b).ratio()
    places: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        places.setdefault(c, []).append(j)
    at, total, todo = [places.get(c, ()) for c in a], 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        best_i, best_j, best, before = alo, blo, 0, {}
        for i in range(alo, ahi):
            now = {}
            for j in at[i]:
                if j >= bhi:
                    break
                if j >= blo:
                    k = now[j] = before.get(j - 1, 0) + 1
                    if k > best:
                        best_i, best_j, best = i - k + 1, j - k + 1, k
            before = now
        if best:
            total += best
            if alo < best_i and blo < best_j:
                todo.append((alo, best_i, blo, best_j))
            if best_i + best < ahi and best_j + best < bhi:
                todo.append((best_i + best, ahi, best_j + best, bhi))
    return 2.0 * total / (len(a) + len(b)) if a or b else 1.0


class Bags:
    """An index of names by their characters and how often each stands before in the name."""

    def __init__(self, names: list[str]):
        self.names, self.lengths = names, np.array([len(x) for x in names], np.int64)
        index = defaultdict(list)
        for i, x in enumerate(names):
            for gram in self.grams(x):
                index[gram].append(i)
        self.index = {k: np.array(v, np.int64) for k, v in index.items()}

    @staticmethod
    def grams(name: str) -> Iterator[tuple[str, int]]:
        seen: dict[str, int] = defaultdict(int)
        for c in name:
            yield c, seen[c]
            seen[c] += 1

    def bounds(self, name: str) -> np.ndarray:
        """No ratio of ``name`` with a name of the block is higher."""
        lists = [self.index[g] for g in self.grams(name) if g in self.index]
        common = np.bincount(np.concatenate(lists), minlength=len(self.names)) if lists else np.zeros(len(self.names), np.int64)
        total = len(name) + self.lengths
        return np.where(total > 0, 2.0 * common / np.maximum(total, 1), 1.0)

    def nearest(self, name: str, most: int, cutoff: float) -> tuple[list[tuple[float, str]], int]:
        """The ``most`` best (ratio, name), ties to the larger name, and how many exact ratios that took."""
        bound = self.bounds(name)
        at = np.flatnonzero(bound >= cutoff)
        best, looked = [], 0
        for i in at[np.argsort(-bound[at], kind="stable")].tolist():
            if len(best) == most and bound[i] < best[0][0]:
                break
            like, looked = ratio(self.names[i], name), looked + 1
            if like >= cutoff:
                (heapq.heappush if len(best) < most else heapq.heappushpop)(best, (like, self.names[i]))
        return sorted(best, reverse=True), looked


def close_names(unknown: DataFrame, pool: DataFrame, group: str = "doc", name: str = "ref", most: int = 3, cutoff: float = 0.6, block: int = BLOCK) -> DataFrame:
    """(group, name, suggested, looked) for each distinct name of ``unknown`` (group, name): the names of its group in ``pool``
    (group, name) with a ratio of ``cutoff`` or more, ``most`` at most, best first; ``looked`` counts exact ratios.

    Rows with null group or name don't count; a group without pool has no suggestions. The empty name is like itself alone.
    """
    asked, names = (d.select(F.col(group).alias("g"), F.col(name).cast("string").alias("s")).where("g IS NOT NULL AND s IS NOT NULL").distinct() for d in (unknown, pool))
    blocks = lambda d, c: d.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(c))
    sizes = blocks(asked, "nu").join(blocks(names, "np"), "g")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("s"), F.col(n)).cast("int")
    left = asked.join(sizes, "g").select("g", every("np").alias("p"), own("nu").alias("u"), F.lit(1).alias("asks"), "s")
    right = names.join(sizes, "g").select("g", own("np").alias("p"), every("nu").alias("u"), F.lit(0).alias("asks"), "s")
    rows = right.unionByName(left).repartition("g", "p", "u").sortWithinPartitions("g", "p", "u", "asks", "s")
    kind = rows.schema["g"].dataType
    out = StructType([rows.schema["g"], rows.schema["s"], *StructType.fromDDL("ratios array<double>, names array<string>, looked long")])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, bags = None, [], None
        for b in batches:
            at, best, looked = [], [], []
            for i, (g, p, u, asks, s) in enumerate(zip(*(b[c].to_pylist() for c in ("g", "p", "u", "asks", "s")))):
                if (g, p, u) != current:
                    current, held, bags = (g, p, u), [], None
                if not asks:
                    held.append(s)
                    continue
                if bags is None:
                    bags, held = Bags(held), []
                found, n = bags.nearest(s, most, cutoff)
                at.append(i)
                best.append(found)
                looked.append(n)
            yield pa.record_batch({
                "g": b["g"].take(pa.array(at, pa.int64())), "s": b["s"].take(pa.array(at, pa.int64())), "ratios": pa.array([[r for r, _ in x] for x in best], pa.list_(pa.float64())),
                "names": pa.array([[n for _, n in x] for x in best], pa.list_(pa.string())), "looked": pa.array(looked, pa.int64()),
            })

    d = rows.mapInArrow(answer, out)
    pairs = d.select("g", "s", "looked", F.explode_outer(F.arrays_zip("ratios", "names")).alias("x"))
    # each block has given its best few
    best = pairs.groupBy("g", "s").agg(F.sort_array(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("x.ratios", "x.names"))), asc=False).alias("x"))
    looked = d.groupBy("g", "s").agg(F.sum("looked").alias("looked"))
    d = asked.join(best, ["g", "s"], "left").join(looked, ["g", "s"], "left")
    suggested = F.coalesce(F.transform(F.slice("x", 1, most), lambda x: x["names"]), F.array().cast("array<string>"))
    return d.select(F.col("g").cast(kind).alias(group), F.col("s").alias(name), suggested.alias("suggested"), F.coalesce("looked", F.lit(0).cast("long")).alias("looked"))
