"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

Two texts link when 100 * |A and B| >= threshold * |A or B| over their sets of word shingles.

1. *Classes.* Equal sets are one class (128-bit digest of the sorted shingle hashes); the smallest id speaks for it.
   A group of a million exact copies is one set from here on.
2. *Sieve.* Two linked sets share k shingles among the smallest n - ceil(t n) + k of each (in hash order). A set of
   which too few such shingles stand in any other set has no link. Only these prefixes are exchanged, as 32-bit keys.
3. *Tiles.* Of the sets left, shingles are ordered rarest first by an exact count; linked sets share one of their
   n - ceil(t n) + 1 rarest. Sets are joined to the smallest set with which they share one, and the connected
   groups, cut by size band (linked sizes are in the same or adjacent bands of ratio 1 / t) and into parts of bounded
   rows, give tiles: pairs of parts.
4. *Inside a tile*, |A xor B| is at least the number of bits in which two hashed bitmaps differ, which bounds the
   overlap from above; pairs that pass are intersected exactly. Pairs already connected are passed over, so a tile
   returns a spanning forest of its links, never all pairs of a group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .blocks import U
from .shared import components, table, written

#: Sets in a part of a tile.
PART_ROWS = 2048


def shingles_of(w: B.Words, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of fewer words than ``size``, the whole sequence as one."""
    h = w.hashes()
    runs = B.windows(h, size, 11)
    out = []
    for lo, n in zip(w.first[:-1].tolist(), w.counts.tolist()):
        if n >= size:
            out.append(np.unique(runs[lo:lo + n - size + 1]))
        elif n:
            out.append(B.windows(h[lo:lo + n], n, 20 + n))
        else:
            out.append(np.zeros(0, U))
    return out


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _least(n: int, percent: int) -> int:
    """The smallest overlap that a set of n shingles can have with a set it links to."""
    return -(-percent * n // 100)


def _k(n: int) -> int:
    return 1 + n // 20


def _concat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, U)


class Tile:
    """Sets of one tile, smallest first; finds a spanning forest of the links."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int):
        order = np.lexsort((ids, [len(s) for s in sets]))
        self.ids, self.sets, self.side, self.percent = ids[order], [sets[i] for i in order], side[order], percent
        self.sizes = np.array([len(s) for s in self.sets])
        self.bits = 64
        while self.bits < min(2 * self.sizes.max(initial=1), 8192):
            self.bits *= 2

    def bitmaps(self) -> np.ndarray:
        out = np.zeros((len(self.sets), self.bits), bool)
        for row, s in zip(out, self.sets):
            row[(s >> U(8)) & U(self.bits - 1)] = True
        return np.packbits(out, axis=1).view(U)

    def links(self) -> list[tuple[int, int]]:
        maps, label, out = self.bitmaps(), np.arange(len(self.sets)), []
        for i in range(len(self.sets) - 1):
            n = self.sizes[i]
            stop = np.searchsorted(self.sizes, n * 100 // self.percent, "right")
            j = np.arange(i + 1, stop)
            j = j[(label[j] != label[i]) & ((self.side[j] != self.side[i]) | (self.side[i] == 2))]
            if not len(j):
                continue
            both = n + self.sizes[j]
            differ = np.bitwise_count(maps[j] ^ maps[i]).sum(1, dtype=np.int64)
            most = (both - differ) // 2
            j = j[100 * most >= self.percent * (both - most)]
            while len(j):  # one intersection at a time for a few, all at once for many
                now, j = j[:256], j[256:]
                now = now[label[now] != label[i]]
                if not len(now):
                    continue
                cut = np.cumsum([0, *self.sizes[now]])
                every = np.concatenate([self.sets[x] for x in now])
                at = np.minimum(np.searchsorted(self.sets[i], every), n - 1)
                shared = np.add.reduceat((self.sets[i][at] == every).astype(np.int64), cut[:-1])
                for x in now[100 * shared >= self.percent * (n + self.sizes[now] - shared)]:
                    if label[x] != label[i]:
                        out.append((int(self.ids[i]), int(self.ids[x])))
                        label[label == label[x]] = label[i]
        return out


def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, n_shingles, class_id, component_id): one row for each row of ``docs``; ``mark`` is a hash of the text.

    ``class_id`` is the smallest id with the same set, ``component_id`` the smallest id reached by links. Rows of one id
    are one document to links, whatever their texts.

    Null text: no words, an empty set, no links: class and component are the row's own id. A text of fewer than
    ``shingle`` words is one shingle. Rows with a null id are counted but have no id to link by: their class and
    component are null. Equal rows are one class. Long texts are taken whole. An empty table gives an empty table;
    other columns don't matter.
    """
    spark = docs.sparkSession
    d, total = B.in_blocks(docs, id_col, text_col)
    n_blocks = max(1, -(-total // B.BLOCK_BYTES))
    d = d.withColumn("mark", F.xxhash64("text"))
    d = d.withColumn("block", F.pmod(F.xxhash64("id", "mark"), F.lit(n_blocks)))

    def sets(batches):
        for b in (x for batch in batches for x in B.pieces(batch, "text")):
            s = shingles_of(B.Words(b["text"], lower=True), shingle)
            yield pa.record_batch({"id": b["id"].cast(pa.int64()), "mark": b["mark"], "set_key": pa.array([_key(x) for x in s], pa.binary()), "n_shingles": pa.array([len(x) for x in s], pa.int64())})

    rows = written(d.select("id", "mark", "text").mapInArrow(sets, "id long, mark long, set_key binary, n_shingles long"), "sets")
    classes = rows.where("id is not null and n_shingles > 0").groupBy("set_key").agg(F.min(F.struct("id", "mark")).alias("r"))
    classes = written(classes.select("set_key", F.col("r.id").alias("sid"), F.col("r.mark").alias("mark")), "classes")
    speakers = classes.select(F.pmod(F.xxhash64("sid", "mark"), F.lit(n_blocks)).alias("block"), F.lit(-1).alias("bucket"), F.lit(-1).alias("part"), F.concat(F.col("set_key")).alias("vals"))
    n_sieve = B.bucket_count(docs, total // 6 * 3 // 10)

    def own(t: pa.Table, told: pa.Table):
        """Ids and sets of the classes for which this block speaks."""
        want = {v for p, v in zip(told["part"].to_pylist(), told["vals"].to_pylist()) if p == -1}
        found: dict = {}  # set_key: least id, which is the sid, and set; copies stand here in any order
        if want:
            for i, s in zip(t["id"].to_pylist(), shingles_of(B.Words(t["text"], lower=True), shingle)):
                if i is not None and len(s) and (k := _key(s)) in want and (k not in found or i < found[k][0]):
                    found[k] = i, s
        return np.array([i for i, _ in found.values()], np.int64), [s for _, s in found.values()]

    def prefixes(s: list[np.ndarray]):
        return [x[: len(x) - _least(len(x), percent) + _k(len(x))] for x in s]

    def ask_sieve(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        _, s = own(t, told)
        return B.requests(key[-1].as_py(), np.unique(_concat(prefixes(s))), n_sieve, bits=32)

    def pass_sieve(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        ids, s = own(t, told)
        p = prefixes(s)
        keys, index, often = np.unique(_concat(p), return_inverse=True, return_counts=True)
        shared = (B.answered(told, 0, keys, n_sieve) | (often > 1))[index]
        cut = np.cumsum([0, *map(len, p)])
        met = np.add.reduceat(shared.astype(np.int64), cut[:-1]) if len(p) else np.zeros(0, np.int64)
        stay = [i for i, x in enumerate(s) if met[i] >= _k(_least(len(x), percent))]
        return pa.table({"sid": pa.array(ids[stay], pa.int64()), "tokens": pa.array([s[i].tobytes() for i in stay], pa.binary())})

    grouped = d.drop("mark").groupBy("block")
    asked = grouped.cogroup(speakers.groupBy("block")).applyInArrow(ask_sieve, B.REQUEST)
    told = B.answers(asked, B.in_many, 0, np.uint32, packed=True)
    left = grouped.cogroup(told.union(speakers).groupBy("block")).applyInArrow(pass_sieve, "sid long, tokens binary")
    left = written(left, "sieved")
    stats = left.agg(F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0)), F.count(F.lit(1))).first()
    roots = _tile_links(left, stats[0], percent)
    if roots is None:
        roots = classes.select(F.col("sid").alias("node"), F.col("sid").alias("component")).limit(0)
    named = classes.join(roots, classes.sid == roots.node, "left").select("set_key", "sid", F.coalesce("component", "sid").alias("component"))
    alone = F.col("n_shingles") == 0
    out = rows.join(named, "set_key", "left")
    return out.select(
        "id", "mark", "n_shingles",
        F.when(alone | F.col("id").isNull(), F.col("id")).otherwise(F.col("sid")).alias("class_id"),
        F.when(alone | F.col("id").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"),
    )


def _tile_links(left: DataFrame, n_bytes: int, percent: int) -> DataFrame | None:
    """(node, component) of the sets that have links."""
    if not n_bytes:
        return None
    n_blocks = max(1, -(-n_bytes // B.BLOCK_BYTES))
    n_bucket = B.bucket_count(left, n_bytes // 8)
    blocked = left.withColumn("block", F.pmod(F.xxhash64("sid"), F.lit(n_blocks))).groupBy("block")

    def whole(t: pa.Table):
        s = [np.frombuffer(x, U) for x in t["tokens"].to_pylist()]
        return np.asarray(t["sid"].to_numpy()), s, *np.unique(_concat(s), return_inverse=True, return_counts=True)

    def count(index, vals, n):
        return np.minimum(np.bincount(index, weights=vals, minlength=n), 65535).astype(np.uint16)

    def least(index, vals, n):
        out = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(out, index, vals)
        return out

    def rarest(t: pa.Table, told: pa.Table):
        """(row, key) of the shared ones among the rarest shingles of each set, and the keys with the least set of each here."""
        ids, s, keys, index, _ = whole(t)
        df = B.answered(told, 0, keys, n_bucket, np.uint16)[index]
        cut, rows, picked = np.cumsum([0, *map(len, s)]), [], []
        for r, (a, b) in enumerate(zip(cut, cut[1:])):
            own = df[a:b]
            p = (b - a) - _least(b - a, percent) + 1
            pick = np.lexsort((index[a:b], own))[:p]
            pick = pick[own[pick] > 1]
            rows.append(np.full(len(pick), r))
            picked.append(index[a:b][pick])
        rows, picked = (np.concatenate(x).astype(np.int64) for x in (rows or [[]], picked or [[]]))
        used, at = np.unique(picked, return_inverse=True)
        low = least(at, ids[rows], len(used))
        return ids, rows, keys[used], at, low

    def ask_count(key, t):
        _, _, keys, _, often = whole(t)
        return B.requests(key[0].as_py(), keys, n_bucket, often.astype(np.uint32))

    def ask_least(key, t, told):
        _, _, keys, _, low = rarest(t, told)
        return B.requests(key[-1].as_py(), keys, n_bucket, low)

    def join_least(key, t, told):
        ids, rows, keys, at, _ = rarest(t, told)
        low = B.answered(told, 1, keys, n_bucket, np.int64)[at]
        edges = np.unique(np.stack([ids[rows], low], 1), axis=0) if len(rows) else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(edges[:, 0], pa.int64()), "b": pa.array(edges[:, 1], pa.int64())})

    counted = B.answers(blocked.applyInArrow(ask_count, B.REQUEST), count, 0, U, np.uint32)
    asked = blocked.cogroup(counted.groupBy("block")).applyInArrow(ask_least, B.REQUEST)
    lowest = B.answers(asked, least, 1, U, np.int64)
    edges = blocked.cogroup(counted.union(lowest).groupBy("block")).applyInArrow(join_least, "a long, b long")
    groups = components(edges, "candidates")
    members = written(left.select("sid", (F.octet_length("tokens") / 8).cast("long").alias("n")).join(groups, F.col("sid") == F.col("node")).select("sid", "n", F.col("component").alias("grp")), "members")
    return components(_links(left, members, percent), "links")


def _links(left: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links of the sets in ``members`` (sid, n, grp), found tile by tile."""
    width = np.log(100 / percent)
    m = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(width) + F.lit(1e-9)).cast("int"))
    # of each group its rows, and how many parts each band has: sizes have few bands
    size = m.groupBy("grp", "band").agg(F.count(F.lit(1)).alias("rows"))
    size = size.groupBy("grp").agg(F.sum("rows").alias("rows"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("rows") / PART_ROWS).cast("int")))).alias("parts"))
    m = m.join(size, "grp")
    name = lambda lo, x, hi, y: F.concat_ws(":", "grp", lo.cast("string"), x.cast("string"), hi.cast("string"), y.cast("string"))
    band = F.col("band")
    parts = lambda b: F.coalesce(F.try_element_at("parts", b), F.lit(0))
    x = F.pmod(F.xxhash64("sid"), parts(band)).cast("int")
    at = lambda tile, side: F.struct(tile.alias("tile"), side.alias("side"))

    def each(n: Column, f) -> Column:
        return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), f)

    # a large group: part x of a band meets the parts y >= x of its band, and all parts of the next band
    spread = F.concat(
        each(parts(band), lambda y: at(name(band, F.least(x, y), band, F.greatest(x, y)), F.when(x == y, 2).when(x < y, 0).otherwise(1))),
        each(parts(band + 1), lambda y: at(name(band, x, band + 1, y), F.lit(0))), each(parts(band - 1), lambda y: at(name(band - 1, y, band, x), F.lit(1))),
    )
    tiles = m.select("sid", F.explode(F.when(F.col("rows") <= PART_ROWS, F.array(at(F.col("grp").cast("string"), F.lit(2)))).otherwise(spread)).alias("t")).select("sid", "t.tile", "t.side")

    def search(key: tuple, t: pa.Table) -> pa.Table:
        tile = Tile(np.asarray(t["sid"].to_numpy()), [np.frombuffer(v, U) for v in t["tokens"].to_pylist()], np.asarray(t["side"].to_numpy()), percent)
        links = tile.links()
        return pa.table({"a": pa.array([p for p, _ in links], pa.int64()), "b": pa.array([q for _, q in links], pa.int64())})

    return left.join(tiles, "sid").groupBy("tile").applyInArrow(search, "a long, b long")


def near_duplicates_dropped(docs: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, one document of each component: that with the smallest doc_id, and of its texts, if there are
    several, that of the least hash.

    Rows with a null doc_id or without words are in no component and stay. Rows equal in id and text are one document.
    Long texts are taken whole. An empty table gives an empty table; columns of any name pass through.
    """
    c = jaccard_components(docs, shingle, percent).where("id is null or n_shingles = 0 or id = component_id")
    alone = F.col("id").isNull() | (F.col("n_shingles") == 0)
    kept = c.groupBy(F.col("id").alias("__id"), F.when(alone, F.col("mark")).alias("__alone")).agg(F.min("mark").alias("__mark"))
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__mark")), "left_semi")


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 5-word shingles, Jaccard similarity of 0.75 or more."""
    out = jaccard_components(table(spark, sf_dir, "documents"), 5, 75)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "class_id")


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
c AS (SELECT k, min(doc_id) AS class_id FROM n GROUP BY k),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 75 * (a.n + b.n - o)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, z.component_id, coalesce(c.class_id, d.doc_id) AS class_id
FROM d JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) z ON z.x = d.doc_id
LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.k = n.k
"""
