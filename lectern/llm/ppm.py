"""Language-model scores: prediction by partial matching over bytes, beside a smoothed unigram base.

A text is its lower-cased words with one blank between them and a line feed as the end; line feeds also stand before
it, so every byte has a full context. The byte trie holds the counts of all training texts for contexts of 0 to 4
bytes. A byte is coded at the longest context that has been seen; if the byte hasn't been seen there, an escape is
coded and the next shorter context tried. Escapes follow method C (as many escapes as distinct bytes), and bytes that
longer contexts have offered are excluded from shorter ones; below order 0 all bytes that are left are equal.

The trie is never in one place. A text's block counts its distinct 5-byte strings and sends each to a bucket by its
hash, where the counts of all blocks are added. The sums, each string once however many blocks hold it, go on to the
bucket of their last two context bytes, which holds the whole subtree of orders 2 to 4 (at most 2**24 strings) and works
out the log probability of each string; the answers go back the same way. So a frequent context costs its distinct
strings and not its share of the text. Orders 0 and 1 are at most 65,536 counts, a table of bounded size that all
buckets get. As bytes seen after a context are also seen after its shorter ones, excluded counts are one number a
context. Word counts take the first exchange and its way back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .blocks import U
from .shared import table, written
from .toxicity import fold

ORDER = 4
END = 10


class Stream:
    """The coded bytes of a column of texts, their 5-byte strings, and where each text begins."""

    def __init__(self, w: B.Words):
        tokens = np.maximum(w.counts, 1)
        size = np.zeros(int(tokens.sum()), np.int64)
        last = np.cumsum(tokens) - 1
        full = np.ones(len(size), bool)
        full[last[w.counts == 0]] = False
        size[full] = w.ends - w.starts
        stop = np.cumsum(size + 1) - 1
        n = int(stop[-1]) + 1 if len(stop) else 0
        out = np.zeros(n, np.uint8)
        body = np.ones(n, bool)
        body[stop] = False
        out[body] = w.raw[w.is_word]
        out[stop] = 32
        out[stop[last]] = END
        self.begin = np.concatenate([[0], stop[last] + 1]).astype(np.int64) if len(tokens) else np.zeros(1, np.int64)
        self.bytes = out
        at = np.arange(n) - np.repeat(self.begin[:-1], np.diff(self.begin))
        key = out.astype(U)
        for j in range(1, ORDER + 1):
            back = np.empty(n, np.uint8)
            back[:j] = END
            back[j:] = out[:-j] if n > j else out[:0]
            back[at < j] = END
            key |= back.astype(U) << U(8 * j)
        self.keys = key

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts."""
    s = np.sort(keys)
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    return s[at], np.diff(np.r_[at, len(s)])


def _lookup(keys: np.ndarray, vals: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key; 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, vals[at], 0)


def _sums(keys: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``vals`` by key."""
    u, index = np.unique(keys, return_inverse=True)
    return u, np.bincount(index, weights=vals, minlength=len(u))


class Level:
    """Counts of one order: c of a context and byte, total and number of bytes of a context, and the count that these
    bytes have at the order below."""

    def __init__(self, strings: np.ndarray, counts: np.ndarray, order: int):
        self.mask = U((1 << (8 * (order + 1))) - 1)
        self.strings, self.counts = _sums(strings & self.mask, counts)

    def close(self, below) -> None:
        ctx = self.strings >> U(8)
        self.ctx, self.total = _sums(ctx, self.counts)
        self.kinds = _sums(ctx, np.ones(len(ctx)))[1]
        self.under = _sums(ctx, below(self.strings))[1]

    def of(self, strings: np.ndarray):
        s = strings & self.mask
        c = s >> U(8)
        return _lookup(self.strings, self.counts, s), *(_lookup(self.ctx, x, c) for x in (self.total, self.kinds, self.under))


def log_probabilities(strings: np.ndarray, counts: np.ndarray, low: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each 5-byte string after the four others.

    ``counts`` are training counts (0: not in training), of all strings that share two last context bytes with any
    here; ``low`` [context, byte] are the counts of order 1.
    """
    seen = counts > 0
    levels = {k: Level(strings[seen], counts[seen].astype(np.float64), k) for k in (4, 3, 2)}
    byte = lambda s, j: ((s >> U(8 * j)) & U(255)).astype(np.int64)
    c0 = low.sum(0)
    some = low > 0
    for k in (4, 3):
        levels[k].close(lambda s, k=k: _lookup(levels[k - 1].strings, levels[k - 1].counts, s & levels[k - 1].mask))
    levels[2].close(lambda s: low[byte(s, 1), byte(s, 0)])
    sym, prev = byte(strings, 0), byte(strings, 1)
    out = np.zeros(len(strings))
    open_ = np.ones(len(strings), bool)
    gone, under = np.zeros(len(strings)), np.zeros(len(strings))  # bytes excluded, and their count at this order
    for k in range(ORDER, -1, -1):
        if k >= 2:
            c, total, kinds, next_under = levels[k].of(strings)
        elif k == 1:
            c, total, kinds, next_under = low[prev, sym], low.sum(1)[prev], some.sum(1)[prev], (some * c0).sum(1)[prev]
        else:
            c, total, kinds, next_under = c0[sym], np.full(len(sym), c0.sum()), np.full(len(sym), (c0 > 0).sum()), np.zeros(len(sym))
        new, left = kinds - gone, total - under
        live = open_ & (new > 0)
        hit = live & (c > 0)
        # at order 0 no escape is needed once all 256 bytes are known
        escapes = np.where((k == 0) & (kinds == 256), 0, new)
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.where(hit, np.log10(c / (left + escapes)), np.where(live, np.log10(escapes / (left + escapes)), 0.0))
        open_ &= ~hit
        gone, under = kinds, next_under
    return out - np.where(open_, np.log10(max(1, 256 - int((c0 > 0).sum()))), 0.0)


def order_one(train: DataFrame) -> np.ndarray:
    """Counts [context, byte] over the texts of ``train``: 65,536 numbers whatever the input."""

    def count(batches):
        total = np.zeros(65536, np.int64)
        for b in (x for batch in batches for x in B.pieces(batch, "text")):
            total += np.bincount((Stream(B.Words(b["text"], lower=True)).keys & U(65535)).astype(np.int64), minlength=65536)
        k = np.flatnonzero(total)
        yield pa.record_batch({"k": pa.array(k, pa.int32()), "n": pa.array(total[k], pa.int64())})

    rows = train.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(65536)
    for k, n in rows:
        out[k] = n
    return out.reshape(256, 256)


SCORED = "id long, held_out boolean, words long, known long, log_counts double, score double, kinds long"


def lm_scores(docs: DataFrame, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row for each row of ``docs``.

    Learns from rows whose fold (crc32 of the id as text, modulo ``folds``) is not ``held``. Null text counts as empty:
    one end token. Rows with a null id have fold 0 and are learnt from. Equal rows count as often as they stand and
    score alike. Without training rows, every byte has probability 1/256. Texts of any length are taken whole. An
    empty table gives an empty table; other columns don't matter.
    """
    d, total = B.in_blocks(docs, id_col, text_col)
    d = d.withColumn("id", F.col("id").cast("long")).withColumn("held_out", fold(F.col("id"), folds) == held)
    low = order_one(d.where("not held_out"))
    n_words, n_strings = B.bucket_count(docs, total // 12), B.bucket_count(docs, total // 12)

    def word_keys(t: pa.Table, train: np.ndarray, w: B.Words):
        h = w.hashes()
        keys, index = np.unique(h, return_inverse=True)
        return keys, index, np.bincount(index[train[w.text_of_word()]], minlength=len(keys))

    def by_context(strings: np.ndarray):
        """The order of strings by the bucket of their last two context bytes, and where each bucket begins."""
        bucket = (B.mix((strings >> U(8)) & U(65535), 3) % U(n_strings)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(n_strings + 1))

    def train_rows(t: pa.Table) -> np.ndarray:
        return ~t["held_out"].to_numpy(zero_copy_only=False).astype(bool)

    def ask(key: tuple, t: pa.Table) -> pa.Table:
        w, train = B.Words(t["text"], lower=True), train_rows(t)
        block = key[0].as_py()
        keys, _, counts = word_keys(t, train, w)
        asked = B.requests(block, keys, n_words, counts.astype(np.uint32))
        s = Stream(w)
        learnt, n = distinct(s.keys[train[s.text_of()]])
        strings, _ = distinct(s.keys)
        more = B.requests(block, strings, n_strings, _lookup(learnt, n, strings).astype(np.uint32))
        return pa.concat_tables([asked, more.set_column(0, "bucket", pa.array(more["bucket"].to_numpy() + n_words, pa.int32()))])

    def merged(t: pa.Table):
        """Where each block's keys end, which of the distinct keys each is, these keys, and the sums of their counts."""
        blobs = [np.frombuffer(x, U) for x in t["keys"].to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in t["vals"].to_pylist()])
        keys, index = np.unique(np.concatenate(blobs), return_inverse=True)
        return np.cumsum([0, *map(len, blobs)]), index, keys, np.bincount(index, weights=counts, minlength=len(keys))

    def add(key: tuple, t: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        cut, index, keys, counts = merged(t)
        if bucket >= n_words:  # sums of strings go on to their contexts
            order, at = by_context(keys)
            used = [b for b in range(n_strings) if at[b] < at[b + 1]]
            k, v = keys[order], counts[order].astype(np.int64)
            return pa.table({
                "block": pa.array([bucket] * len(used), pa.int64()), "bucket": pa.array(used, pa.int32()), "part": pa.array([ON] * len(used), pa.int32()),
                "keys": pa.array([k[at[b]:at[b + 1]].tobytes() for b in used], pa.binary()), "vals": pa.array([v[at[b]:at[b + 1]].tobytes() for b in used], pa.binary()),
            })
        out = counts.astype(np.uint32 if counts.max(initial=0) < 2**32 else U)[index]
        # the last row is the number of known words of this bucket, for no block
        vals = [out[a:b].tobytes() for a, b in zip(cut, cut[1:])] + [np.int64((counts > 0).sum()).tobytes()]
        blocks = [*t["block"].to_pylist(), -1]
        return pa.table({
            "block": pa.array(blocks, pa.int64()), "bucket": pa.array([bucket] * len(blocks), pa.int32()), "part": pa.array([0] * (len(blocks) - 1) + [2], pa.int32()),
            "keys": pa.nulls(len(blocks), pa.binary()), "vals": pa.array(vals, pa.binary()),
        })

    def contexts(key: tuple, t: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, U) for x in t["keys"].to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in t["vals"].to_pylist()])
        out = log_probabilities(np.concatenate(blobs), counts.astype(np.float64), low).astype(np.float32)
        cut = np.cumsum([0, *map(len, blobs)])
        return pa.table({
            "bucket": t["block"].cast(pa.int32()), "context": pa.array([key[0].as_py()] * len(blobs), pa.int32()), "vals": pa.array([out[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
        })

    def answer(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows or key[0].as_py() < n_words:
            return ANSWERED.empty_table()
        cut, index, keys, _ = merged(t)
        logp = np.zeros(len(keys), np.float32)
        order, at = by_context(keys)
        for c, v in zip(told["context"].to_pylist(), told["vals"].to_pylist()):
            logp[order[at[c]:at[c + 1]]] = np.frombuffer(v, np.float32)
        out = logp[index]
        n = t.num_rows
        return pa.table({
            "block": t["block"].cast(pa.int64()), "bucket": pa.array([key[0].as_py()] * n, pa.int32()), "part": pa.array([1] * n, pa.int32()), "vals": pa.array([out[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
        })

    def score(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        if key[-1].as_py() == -1:
            kinds = sum(int(np.frombuffer(v, np.int64)[0]) for v in told["vals"].to_pylist())
            return pa.table({"id": [None], "held_out": [None], "words": [0], "known": [0], "log_counts": [0.0], "score": [0.0], "kinds": [kinds]}, schema=SCHEMA)
        w = B.Words(t["text"], lower=True)
        s = Stream(w)
        words, index = np.unique(w.hashes(), return_inverse=True)
        counts, order, cut = np.zeros(len(words)), *B.by_bucket(words, n_words)[::2]
        strings, _ = distinct(s.keys)
        logp = np.zeros(len(strings))
        order_s, cut_s = B.by_bucket(strings, n_strings)[::2]
        for bucket, part, v in zip(told["bucket"].to_pylist(), told["part"].to_pylist(), told["vals"].to_pylist()):
            if part:
                b = bucket - n_words
                logp[order_s[cut_s[b]:cut_s[b + 1]]] = np.frombuffer(v, np.float32)
            else:
                n = int(cut[bucket + 1] - cut[bucket])
                counts[order[cut[bucket]:cut[bucket + 1]]] = np.frombuffer(v, np.uint32 if len(v) == 4 * n else U)
        per_word, n = np.log10(counts + 1)[index], len(t)
        of, c = w.text_of_word(), counts[index]
        total = np.bincount(s.text_of(), weights=logp[np.searchsorted(strings, s.keys)], minlength=n)
        return pa.table({
            "id": t["id"].cast(pa.int64()), "held_out": t["held_out"], "words": w.counts.astype(np.int64), "known": np.bincount(of, weights=c > 0, minlength=n).astype(np.int64),
            "log_counts": np.bincount(of, weights=per_word, minlength=n).astype(np.float64), "score": total, "kinds": pa.array([None] * n, pa.int64()),
        }, schema=SCHEMA)

    grouped = d.groupBy("block")
    asked = grouped.applyInArrow(ask, B.REQUEST).groupBy("bucket")
    sums = asked.applyInArrow(add, "block long, bucket int, part int, keys binary, vals binary")
    chances = sums.where(F.col("part") == ON).drop("part").groupBy("bucket").applyInArrow(contexts, "bucket int, context int, vals binary")
    told = asked.cogroup(chances.groupBy("bucket")).applyInArrow(answer, B.ANSWER).union(sums.where(F.col("part") != ON).drop("keys"))
    out = written(grouped.cogroup(told.groupBy("block")).applyInArrow(score, SCORED), "scored")
    real = out.where("held_out is not null")
    ends, words = real.where("not held_out").agg(F.count(F.lit(1)), F.coalesce(F.sum("words"), F.lit(0))).first()
    kinds = (out.where("held_out is null").agg(F.sum("kinds")).first()[0] or 0) + (ends > 0)
    n = words + ends
    n_tokens = F.col("words") + 1
    return real.select(
        "id", "held_out", n_tokens.alias("n_tokens"), (F.col("known") + F.lit(int(ends > 0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_counts") + F.log10(F.lit(float(ends + 1))) - n_tokens * F.log10(F.lit(float(n + kinds + 1)))).alias("base_score"), "score",
    )


ON = 8  # part of sums that go on
ANSWERED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("part", pa.int32()), ("vals", pa.binary())])
SCHEMA = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("words", pa.int64()), ("known", pa.int64()), ("log_counts", pa.float64()), ("score", pa.float64()), ("kinds", pa.int64())])


def op4_ppm_scores(spark, sf_dir: str) -> DataFrame:
    """PPM and unigram scores of all documents."""
    return lm_scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
