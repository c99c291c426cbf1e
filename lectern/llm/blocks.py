"""Texts in blocks, hashed with numpy, and questions that all blocks ask of the whole corpus.

A *block* is a set of rows of a few MB, chosen by a hash of the row, so blocks are even whatever the sources or
keys are. Inside a task a block is one Arrow table; words and windows are hashed for the whole block at once.

An *exchange* answers "what do all blocks together know of this key?" (in how many blocks it stands, the sum of
its counts, the least of its values). Each block sends its distinct keys, cut by bucket, as one packed row a
bucket, so a key that a third of all rows hold arrives once per block; each bucket combines what it got and sends
one packed answer back to each block. Keys are hashes, hence buckets are even, and their number follows the input.
The plan is groupBy(block) -> groupBy(bucket) -> cogroup(block): plain shuffles, which Spark repeats when an
executor is lost. A block finds its keys again from its own rows, in the order of the key, so the answer needs no
row numbers and doesn't depend on the order of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shuffle_partitions

BLOCK_BYTES = 3_000_000
U = np.uint64
_STEP = 0xC2B2AE3D27D4EB4F | 1


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that leaves no linear trace."""
    x = x + U((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span.

    Bytes are taken in words of eight, each mixed with its place in the span before they are added, so no structure of
    the bytes survives; a plain polynomial modulo 2**64 gives equal values for some unlike strings whatever its base.
    """
    n = ends - starts
    out = mix(n.astype(U), 13)
    if not len(n):
        return out
    eight = np.zeros(len(raw) + 8, U)  # the eight bytes from each place on, little end first
    eight[: len(raw)] = raw
    for k in (1, 2, 4):
        eight[:-k] |= eight[k:] << U(8 * k)
    keep = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)
    live = np.arange(len(n))
    for k in range(64):
        out[live] += mix(eight[starts[live] + 8 * k] & keep[np.minimum(n[live] - 8 * k, 8)], 17 + k)
        live = live[n[live] > 8 * (k + 1)]
        if not len(live):
            break
    for i in live.tolist():  # spans of over 512 bytes, one at a time
        w = np.arange(64, -(-int(n[i]) // 8))
        v = eight[starts[i] + 8 * w] & keep[np.minimum(n[i] - 8 * w, 8)]
        out[i:i + 1] += mix(v + mix(w.astype(U), 3), 16).sum(dtype=U)
    return mix(out, 19)


class Words:
    """The words of a column of texts: byte spans, 64-bit hashes, and the first word of each text."""

    def __init__(self, column: pa.ChunkedArray, lower: bool = False):
        a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        a = a if isinstance(a, pa.Array) else pa.concat_arrays(a.chunks)
        a = a.fill_null("").cast(pa.large_string())
        n = len(a)
        offsets = np.frombuffer(a.buffers()[1], np.int64, n + 1, a.offset * 8) if n else np.zeros(1, np.int64)
        lo, hi = int(offsets[0]), int(offsets[-1])
        raw = np.frombuffer(a.buffers()[2], np.uint8, hi)[lo:] if hi > lo else np.zeros(0, np.uint8)
        self.offsets = offsets - lo
        if lower:
            raw = raw + np.where((raw >= 65) & (raw <= 90), 32, 0).astype(np.uint8)
        self.raw = raw
        word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        self.is_word = word
        first = np.empty(len(raw) + 1, bool)  # a word can start here: no word before, or another text
        first[0] = first[-1] = True
        first[1:-1] = ~word[:-1]
        first[self.offsets] = True
        self.starts = np.flatnonzero(word & first[:-1])
        stop = np.empty(len(raw), bool)
        if len(raw):
            stop[:-1] = ~word[1:]
            stop[-1] = True
            inner = self.offsets[(self.offsets > 0) & (self.offsets <= len(raw))]
            stop[inner - 1] = True
        self.ends = np.flatnonzero(word & stop) + 1
        self.first = np.searchsorted(self.starts, self.offsets)  # of each text, and the total
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.raw, self.starts, self.ends)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(h: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``size`` words; run i starts at word i. Runs over two texts are among them.

    Runs of 1, 2, 4 … words are hashed from their halves, and those that make up ``size`` are put together.
    """
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U)

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a * U(_STEP) + b)

    part, length, at, out = mix(h, seed + 1), 1, 0, None
    while at < size:
        if (size - at) & length:
            own = part[at:at + n]
            out = own if out is None else join(out, own)
            at += length
        if at < size:
            part, length = join(part[:-length], part[length:]), 2 * length
    return mix(out, seed)


def pieces(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES):
    """Runs of rows of ``batch`` with about ``limit`` bytes in ``column``, so that hashing needs bounded memory."""
    size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(size) // limit
    cut = np.flatnonzero(np.diff(piece, prepend=-1))
    for a, b in zip(cut, [*cut[1:], len(size)]):
        yield batch.slice(a, b - a)


def in_blocks(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(block, id, text) and the bytes of all texts; other columns don't come along."""
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    return d.select(F.pmod(F.xxhash64("id", "text"), F.lit(n)).alias("block"), "id", "text"), total


def bucket_count(df: DataFrame, keys: int) -> int:
    """As many buckets as shuffle partitions, and more where one would get over about 1.5 million keys."""
    return max(shuffle_partitions(df.sparkSession), -(-keys // 1_500_000))


REQUEST = "bucket int, block long, keys binary, vals binary"
ANSWER = "block long, bucket int, part int, vals binary"


def by_bucket(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys ordered by bucket: (order, sorted keys, first of each bucket)."""
    bucket = (mix(keys, 7) % U(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, keys[order], np.searchsorted(bucket[order], np.arange(n + 1))


def requests(block: int, keys: np.ndarray, n: int, vals: np.ndarray | None = None, bits: int = 64) -> pa.Table:
    """One row a bucket. ``keys`` are sorted and distinct; the lower ``bits`` of each travel."""
    order, k, cut = by_bucket(keys, n)
    k = k.astype(np.uint32 if bits == 32 else U)
    v = None if vals is None else vals[order]
    used = [b for b in range(n) if cut[b] < cut[b + 1]]
    return pa.table({
        "bucket": pa.array(used, pa.int32()), "block": pa.array([block] * len(used), pa.int64()),
        "keys": pa.array([k[cut[b]:cut[b + 1]].tobytes() for b in used], pa.binary()),
        "vals": pa.array([None if v is None else v[cut[b]:cut[b + 1]].tobytes() for b in used], pa.binary()),
    })


def answers(requested: DataFrame, combine: Callable, part: int = 0, key_type=U, val_type=None, packed: bool = False) -> DataFrame:
    """``combine(index, values, n)`` gives one value for each of n distinct keys; index says whose value each is."""
    key_type = np.dtype(key_type)

    def answer(key: tuple, t: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, key_type) for x in t["keys"].to_pylist()]
        vals = None if val_type is None else np.concatenate([np.frombuffer(x, val_type) for x in t["vals"].to_pylist()])
        distinct, index = np.unique(np.concatenate(blobs), return_inverse=True)
        out = combine(index, vals, len(distinct))[index]
        cut = np.cumsum([0, *map(len, blobs)])
        pack = (lambda x: np.packbits(x).tobytes()) if packed else (lambda x: x.tobytes())
        return pa.table({
            "block": t["block"].cast(pa.int64()), "bucket": pa.array([key[0].as_py()] * len(blobs), pa.int32()), "part": pa.array([part] * len(blobs), pa.int32()),
            "vals": pa.array([pack(out[a:b]) for a, b in zip(cut, cut[1:])], pa.binary()),
        })

    return requested.groupBy("bucket").applyInArrow(answer, ANSWER)


def answered(t: pa.Table, part: int, keys: np.ndarray, n: int, val_type=None) -> np.ndarray:
    """The answers of one part to ``keys`` (sorted, distinct), in the order of the keys; bits if no val_type."""
    order, _, cut = by_bucket(keys, n)
    out = np.zeros(len(keys), bool if val_type is None else val_type)
    for bucket, p, vals in zip(t["bucket"].to_pylist(), t["part"].to_pylist(), t["vals"].to_pylist(), strict=True):
        if p == part:
            a, b = cut[bucket], cut[bucket + 1]
            got = np.unpackbits(np.frombuffer(vals, np.uint8), count=b - a).astype(bool) if val_type is None else np.frombuffer(vals, val_type)
            out[order[a:b]] = got
    return out


def in_many(index: np.ndarray, vals: np.ndarray | None, n: int) -> np.ndarray:
    """Combiner: whether more than one block has the key."""
    return np.bincount(index, minlength=n) > 1
