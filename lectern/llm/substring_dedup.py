"""Substring dedup with difference-cover anchors.

A window is ``window`` consecutive words of one text. Every word that stands in a window whose word sequence also
starts anywhere else, in the same text or another, is removed; windows are judged on the input.

Method. D is a difference cover modulo ``period``: for any two positions i and j some shift s < period puts both
i + s and j + s on D. So two equal windows hold an equal *anchor*, a run of window - period + 1 words, that starts
on D in both. Only anchors on D are hashed and exchanged (about a quarter of all positions); where an anchor stands
more than once, the windows around it are the extended matches: their full 96-bit hashes are exchanged, and a
window that is met twice is a repeat. Nothing is paired, so a passage with a million copies costs what a million
other passages cost, and each block sends a hash once however often it holds it.
"""

from __future__ import annotations

from itertools import combinations, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .blocks import U
from .shared import table

SPANS = "id long, n_words long, n_removed long, spans array<struct<first:long,last:long>>, kept string"


def difference_cover(period: int) -> list[int]:
    """A smallest set D with 0 in it such that every number modulo ``period`` is a difference of two of D."""
    size = 1
    while size * (size - 1) + 1 < period:
        size += 1
    while True:
        for rest in combinations(range(1, period), size - 1):
            d = (0, *rest)
            if len({(a - b) % period for a in d for b in d}) == period:
                return list(d)
        size += 1


def _anchors(w: B.Words, h: np.ndarray, window: int, cover: list[int], period: int):
    """(word index, hash) of the anchors of texts that have a window."""
    size = window - period + 1
    start = np.repeat(w.first[:-1], w.counts)
    left = np.repeat(w.first[1:], w.counts) - np.arange(len(h))
    on = np.zeros(period, bool)
    on[cover] = True
    ok = on[(np.arange(len(h)) - start) % period] & (left >= size) & np.repeat(w.counts >= window, w.counts)
    at = np.flatnonzero(ok)
    return at, (B.windows(h, size)[at] if len(at) else np.zeros(0, U))


def _repeated_windows(w, h, window, cover, period, shared_anchor, at):
    """First words of the windows that hold an anchor which stands elsewhere, and their two hashes."""
    n = len(h)
    near = np.zeros(n + 1, np.int32)
    hit = at[shared_anchor]
    np.add.at(near, np.maximum(hit - (period - 1), 0), 1)
    np.add.at(near, hit + 1, -1)
    left = np.repeat(w.first[1:], w.counts) - np.arange(n)
    first = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (left >= window))
    if not len(first):
        return first, np.zeros(0, U), np.zeros(0, U)
    return first, B.windows(h, window, 3)[first], B.windows(h, window, 5)[first] & U(0xFFFFFFFF)


def _distinct(a: np.ndarray, b: np.ndarray):
    """Sorted distinct pairs: (a, b, index of each pair, how often each stands)."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.empty(len(x), bool)
    new[:1] = True
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    rank = np.cumsum(new) - 1
    index = np.empty(len(x), np.int64)
    index[order] = rank
    return x[new], y[new], index, np.bincount(rank) if len(x) else np.zeros(0, np.int64)


def remove_repeated_passages(docs: DataFrame, window: int = 35, period: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, spans, kept): one row for each row of ``docs``.

    ``spans`` are the removed runs as word numbers [first, last]; ``kept`` is the other words joined by one blank.
    ``period`` (at most ``window``) is the cover's: larger means fewer but shorter anchors.

    Null text: no words. Empty texts and texts of under ``window`` words lose nothing, whatever their length; long
    texts are taken whole. Rows with equal text, or an equal or null id, are rows of their own, so both repeats of
    a row lose their words. An empty table gives an empty table. Other columns of ``docs`` don't matter.
    """
    period = min(21, max(1, window - 4)) if period is None else period
    cover = difference_cover(period)
    d, total = B.in_blocks(docs, id_col, text_col)
    n_anchor = B.bucket_count(docs, total // 6 * len(cover) // period)
    n_window = B.bucket_count(docs, total // 6)
    grouped = d.groupBy("block")

    def anchors_of(t: pa.Table):
        w = B.Words(t["text"])
        h = w.hashes()
        at, a = _anchors(w, h, window, cover, period)
        return w, h, at, *np.unique(a, return_inverse=True, return_counts=True)

    def ask_anchors(key: tuple, t: pa.Table) -> pa.Table:
        _, _, _, keys, _, _ = anchors_of(t)
        return B.requests(key[0].as_py(), keys, n_anchor, bits=32)

    def windows_of(t: pa.Table, told: pa.Table):
        w, h, at, keys, index, often = anchors_of(t)
        elsewhere = (B.answered(told, 0, keys, n_anchor) | (often > 1))[index]
        return w, *_repeated_windows(w, h, window, cover, period, elsewhere, at)

    def ask_windows(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        _, _, a, b = windows_of(t, told)
        x, y, _, _ = _distinct(a, b)
        order, k, cut = B.by_bucket(x, n_window)
        k, v = k.view(np.uint64), y[order].astype(np.uint32)
        pairs = np.empty(len(k), [("a", "<u8"), ("b", "<u4")])
        pairs["a"], pairs["b"] = k, v
        used = [i for i in range(n_window) if cut[i] < cut[i + 1]]
        return pa.table({
            "bucket": pa.array(used, pa.int32()), "block": pa.array([key[0].as_py()] * len(used), pa.int64()),
            "keys": pa.array([pairs[cut[i]:cut[i + 1]].tobytes() for i in used], pa.binary()), "vals": pa.nulls(len(used), pa.binary()),
        })

    def answer_windows(key: tuple, t: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, [("a", "<u8"), ("b", "<u4")]) for x in t["keys"].to_pylist()]
        whole = np.concatenate(blobs)
        _, _, index, often = _distinct(whole["a"], whole["b"])
        many = (often > 1)[index]
        cut = np.cumsum([0, *map(len, blobs)])
        return pa.table({
            "block": t["block"].cast(pa.int64()), "bucket": pa.array([key[0].as_py()] * len(blobs), pa.int32()), "part": pa.array([1] * len(blobs), pa.int32()),
            "vals": pa.array([np.packbits(many[i:j]).tobytes() for i, j in zip(cut, cut[1:])], pa.binary()),
        })

    def cut_out(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        w, first, a, b = windows_of(t, told)
        x, _, index, often = _distinct(a, b)
        repeat = first[(B.answered(told, 1, x, n_window) | (often > 1))[index]] if len(first) else first
        cover_of = np.zeros(len(w.starts) + 1, np.int32)
        np.add.at(cover_of, repeat, 1)
        np.add.at(cover_of, repeat + window, -1)
        gone = np.cumsum(cover_of[:-1]) > 0
        lost = np.diff(np.concatenate(([0], np.cumsum(gone)))[w.first])
        kept, spans = [], []
        for i, text in enumerate(t["text"].to_pylist()):
            ws = (text or "").encode().split()  # bytes.split() cuts at the same six characters
            lo, hi = w.first[i], w.first[i + 1]
            if lost[i]:
                own = gone[lo:hi]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
                spans.append([{"first": int(p), "last": int(q) - 1} for p, q in zip(edge[::2], edge[1::2])])
                ws = compress(ws, (~own).tolist())
            else:
                spans.append([])
            kept.append(b" ".join(ws).decode())
        return pa.table({
            "id": t["id"].cast(pa.int64()), "n_words": pa.array(w.counts, pa.int64()), "n_removed": pa.array(lost, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), "kept": pa.array(kept, pa.string()),
        })

    anchored = B.answers(grouped.applyInArrow(ask_anchors, B.REQUEST), B.in_many, 0, np.uint32, packed=True)
    asked = grouped.cogroup(anchored.groupBy("block")).applyInArrow(ask_windows, B.REQUEST)
    repeats = asked.groupBy("bucket").applyInArrow(answer_windows, B.ANSWER)
    told = anchored.union(repeats)
    return grouped.cogroup(told.groupBy("block")).applyInArrow(cut_out, SPANS)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated 35-word windows, as a digest."""
    out = remove_repeated_passages(table(spark, sf_dir, "documents"), 35)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
r AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(0, 35)) AS k FROM w WHERE h IN (SELECT h FROM r))),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n_kept FROM p ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
