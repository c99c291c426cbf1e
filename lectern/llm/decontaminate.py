"""Benchmark decontamination by latent semantic retrieval, with subsequence and answer checks.

Words are hashed to ``FEATURES`` dimensions and weighted by inverse passage frequency over all documents. A randomised
SVD (a seeded range finder and Nystroem's step, from one sum of partial products over Spark partitions) gives the
latent space; its two matrices are FEATURES x RANK whatever the input. Frequencies, the fit, search and checks cover every
document whole; a caller may bound the texts of the fit by ``fit_bytes``, the queries don't.

Candidates are windows near an item by cosine in the whitened space: windows of three lengths at every eighth word, and
windows of the item's own length, and one and a half times it, at its words. A candidate is then checked by the longest
common subsequence of words, and by whether the item's last words, its answer, stand in the passage too. Only windows that
these checks could accept get a cosine at all: such a window holds enough of the item's words, and so some of its rarest
ones close together. The threshold is set by recall: against all windows, whatever their cosine, on items of 4 to 130 words
planted in documents of the tables (see README). Items go to the tasks in blocks of at most ``ITEM_ROWS``, one block after
another; more items mean more passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .blocks import U
from .shared import table, written

FEATURES, RANK, PASSAGE = 1 << 15, 48, 32
WINDOWS, STRIDE, COSINE = (16, 32, 48), 8, 0.2
#: Words that a product takes at once, and passages (some 60 MB) that a task of the fit takes where cores are few.
GRAM_WORDS, FIT_PASSAGES = 65_536, 300_000
ITEM_ROWS, PIECE, PLACES = 4096, 1_000_000, 4_000_000


def features(h: np.ndarray) -> np.ndarray:
    return (B.mix(h, 5) & U(FEATURES - 1)).astype(np.int64)


def _passages(w: B.Words) -> np.ndarray:
    """The passage of each word: runs of PASSAGE words of one text, numbered over the piece."""
    at = np.arange(len(w.starts)) - np.repeat(w.first[:-1], w.counts)
    return np.cumsum(at % PASSAGE == 0) - 1


def passage_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """idf of each feature over the passages of all texts, and how many passages there are."""

    def count(batches):
        total, n = np.zeros(FEATURES, np.int64), 0
        for b in (x for batch in batches for x in B.pieces(batch, "text", PIECE)):
            w = B.Words(b["text"], lower=True)
            if len(w.starts):
                p = _passages(w)
                n += int(p[-1]) + 1
                total += np.bincount(np.unique(p * FEATURES + features(w.hashes())) % FEATURES, minlength=FEATURES)
        k = np.flatnonzero(total)
        yield pa.record_batch({"k": pa.array([*k, -1], pa.int32()), "n": pa.array([*total[k], n], pa.int64())})

    rows = texts.mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(FEATURES), 0
    for k, c in rows:
        if k < 0:
            n = c
        else:
            df[k] = c
    return np.log((1 + n) / (1 + df)).astype(np.float32), n


def _sums(rows: np.ndarray, at: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums of ``rows[at]`` over the runs of ``at`` that begin at ``cut``: runs in parts of PASSAGE, all parts' next rows at once."""
    size = np.diff(cut, append=len(at))
    many = -(-size // PASSAGE)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    begin, left = np.repeat(cut, many) + place * PASSAGE, np.minimum(np.repeat(size, many) - place * PASSAGE, PASSAGE)
    order = np.argsort(-left, kind="stable")
    begin, longer = begin[order], len(left) - np.cumsum(np.bincount(left, minlength=PASSAGE + 1))
    parts = np.take(rows, at[begin], axis=0)
    for j in range(1, PASSAGE):
        n = longer[j]
        if not n:
            break
        parts[:n] += np.take(rows, at[begin[:n] + j], axis=0)
    out = np.empty_like(parts)
    out[order] = parts
    return out if len(out) == len(cut) else np.add.reduceat(out, np.cumsum(many) - many)


def _gram_product(texts: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A^T A basis, A being the TF-IDF passages: partial sums a partition, added by Spark in runs of features."""
    rank, run = basis.shape[1], 1024
    weighted = basis * idf[:, None]

    def multiply(batches):
        total = np.zeros((FEATURES, rank))
        for b in (x for batch in batches for x in B.pieces(batch, "text", PIECE)):
            w = B.Words(b["text"], lower=True)
            if not len(w.starts):
                continue
            f, p = features(w.hashes()), _passages(w)
            ends = np.r_[np.flatnonzero(np.diff(p)) + 1, len(p)]
            cuts = [0, *ends[np.flatnonzero(np.diff(ends // GRAM_WORDS, append=-1))].tolist()]  # no passage is cut
            for lo, hi in zip(cuts, cuts[1:]):
                ff, pp = f[lo:hi], p[lo:hi] - p[lo]
                y = _sums(weighted, ff, np.flatnonzero(np.r_[True, pp[1:] != pp[:-1]]))
                order = np.argsort(ff.astype(np.uint16), kind="stable")
                own = ff[order]
                cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                total[own[cut]] += _sums(y, pp[order], cut)
        if total.any():
            total *= idf[:, None]
            yield pa.record_batch({"run": pa.array(range(FEATURES // run), pa.int32()), "part": pa.array([x.astype(np.float32).tobytes() for x in total.reshape(FEATURES // run, -1)], pa.binary())})

    def add(key: tuple, t: pa.Table) -> pa.Table:
        out = np.zeros(run * rank)
        for x in t["part"].to_pylist():
            out += np.frombuffer(x, np.float32)
        return pa.table({"run": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([out.tobytes()], pa.binary())})

    out = np.zeros((FEATURES // run, run * rank))
    for k, x in texts.mapInArrow(multiply, "run int, part binary").groupBy("run").applyInArrow(add, "run int, part binary").collect():
        out[k] = np.frombuffer(x, np.float64)
    return out.reshape(FEATURES, rank)


def latent_space(texts: DataFrame, idf: np.ndarray, seed: int = 11) -> np.ndarray:
    """FEATURES x RANK: right singular vectors over singular values, of the TF-IDF passages of ``texts``."""
    start = np.random.default_rng(seed).standard_normal((FEATURES, RANK)).astype(np.float32)
    y = _gram_product(texts, idf, start)
    # Nystroem: A^T A is near y (start^T y)^-1 y^T, on the same range as y, so one product over all passages is enough
    within, turn = np.linalg.eigh((start.T @ y + y.T @ start) / 2)
    good = within > max(within.max(initial=0) * 1e-9, 1e-12)
    if not good.any():
        return start * idf[:, None]
    vectors, values, _ = np.linalg.svd((y @ turn[:, good]) / np.sqrt(within[good]), full_matrices=False)
    power = values ** 2
    good = power > max(power.max(initial=0) * 1e-9, 1e-12)
    return (vectors[:, good] / np.sqrt(power[good]) * idf[:, None]).astype(np.float32)


def common_subsequence(item: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    at: dict[int, int] = {}
    for i, x in enumerate(item):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(item)) - 1
    row = full
    for x in words:
        m = at.get(x)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(item) - row.bit_count()


class Items:
    """A block of benchmark items: ids, words, and unit vectors of the latent space."""

    def __init__(self, rows: list, space: np.ndarray):
        w = B.Words(pa.array([r["text"] for r in rows], pa.large_string()), lower=True)
        h = w.hashes()
        self.ids, self.words, skips, vectors, bags = [], [], [], [], []
        self.vocabulary = np.unique(h)
        for i, (a, n) in enumerate(zip(w.first[:-1].tolist(), w.counts.tolist())):
            # a long item has one vector for each run of the longest window
            for lo in range(0, n, WINDOWS[-1]):
                if lo and n - lo < WINDOWS[-1] // 2:
                    continue
                vectors.append(space[features(h[a + lo:a + min(n, lo + WINDOWS[-1])])].sum(0))
                self.ids.append(rows[i]["item_id"])
                self.words.append(h[a:a + n].tolist())
                skips.append(lo)
                u, times = np.unique(h[a:a + n], return_counts=True)
                bags.append((np.searchsorted(self.vocabulary, u), times))
        self.sizes, self.skips = np.array([len(x) for x in self.words], np.int64), np.array(skips, np.int64)
        self.bags = bags
        self.bag_items = np.repeat(np.arange(len(bags)), [len(u) for u, _ in bags]) if bags else np.zeros(0, np.int64)
        self.bag_words, self.bag_times = (np.concatenate([x[i] for x in bags]) if bags else np.zeros(0, np.int64) for i in (0, 1))
        v = np.array(vectors, np.float32).reshape(-1, space.shape[1])
        self.vectors = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-20)

    def places(self, h: np.ndarray) -> np.ndarray:
        """The place of each word in the vocabulary, one past its end for others."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at, len(self.vocabulary)).astype(np.int32)

    def words_in_common(self, j: int, places: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Words that item j and each run lo to hi have in common, with repeats: no common subsequence is longer."""
        own, times = self.bags[j]
        other = len(own)
        of_item = np.full(len(self.vocabulary) + 1, other, np.int32)
        of_item[own] = np.arange(other)
        width, out = int((hi - lo).max()), np.zeros(len(lo), np.int64)
        rows = max(1, 1_000_000 // width)
        for a in range(0, len(lo), rows):
            i = lo[a:a + rows, None] + np.arange(width)
            x = np.where(i < hi[a:a + rows, None], of_item[places[np.minimum(i, len(places) - 1)]], other)
            x = x + np.arange(len(x))[:, None] * (other + 1)
            seen = np.bincount(x.ravel(), minlength=len(x) * (other + 1)).reshape(len(x), -1)[:, :other]
            out[a:a + rows] = np.minimum(seen, times).sum(1)
        return out


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges lo to hi (exclusive), and which range each is of."""
    many = np.maximum(hi - lo, 0)
    of = np.repeat(np.arange(len(lo)), many)
    return np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + lo[of], of


def _apart(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Ranges of a group, ends ascending, cut so that none repeats what an earlier one has: the new beginnings."""
    before = np.where(np.r_[False, group[1:] == group[:-1]], np.r_[0, hi[:-1]], lo) if len(lo) else lo
    return np.maximum(lo, before)


def leaks_of(w: B.Words, items: Items, space: np.ndarray, least: float, with_answer: float, answer: int, cosine: float = COSINE) -> list[dict]:
    """For each text: item id -> share of the item's words found in order.

    A passage that holds ``need`` words of an item holds some of its rarest ones. Where these stand close enough
    together is found first, for all items at once, and only such places are compared by cosine and looked into.
    """
    found: list[dict] = [{} for _ in w.counts]
    if not len(items.ids) or not len(w.starts):
        return found
    h = w.hashes()
    f, places = features(h), items.places(h)
    text_of = w.text_of_word()
    begin, end = w.first[:-1][text_of], w.first[1:][text_of]
    start = np.flatnonzero((np.arange(len(h)) - begin) % STRIDE == 0)
    sizes, skips = items.sizes, items.skips
    need = np.array([next(x for x in range(1, n + 1) if x / n >= min(least, with_answer)) for n in sizes.tolist()])

    standing = np.argsort(places, kind="stable")  # where each word of the vocabulary stands
    first = np.searchsorted(places[standing], np.arange(len(items.vocabulary) + 1))
    often = np.diff(first)[items.bag_words]
    order = np.lexsort((often, items.bag_items))
    item, word, often, times = items.bag_items[order], items.bag_words[order], often[order], items.bag_times[order]
    held = np.cumsum(times)
    held -= np.r_[0, np.cumsum(sizes)[:-1]][item]
    rare = held - times < np.minimum(sizes, sizes - need + 1 + sizes // 7)[item]
    item, word, often, times = item[rare], word[rare], often[rare], times[rare]
    least_rare = need - (sizes - np.bincount(item, weights=times, minlength=len(sizes)).astype(np.int64))

    def enough(k: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which runs lo to hi hold enough words of item k."""
        out = np.zeros(len(k), bool)
        by = np.argsort(k, kind="stable")
        for own in np.split(by, np.flatnonzero(np.diff(k[by])) + 1) if len(k) else []:
            i = int(k[own[0]])
            out[own] = items.words_in_common(i, places, lo[own], hi[own]) >= need[i]
        return out

    def look(k: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        fits = np.flatnonzero(enough(k, lo, hi))
        for i, a, b in zip(k[fits].tolist(), lo[fits].tolist(), hi[fits].tolist()):
            leaks = found[int(text_of[a])]
            if items.ids[i] not in leaks:
                own, x = items.words[i], h[a:b].tolist()
                share, tail = common_subsequence(own, x) / len(own), own[-answer:]
                if share >= least or (share >= with_answer and common_subsequence(tail, x) == len(tail)):
                    leaks[items.ids[i]] = share

    def near(at: np.ndarray, width: np.ndarray, k: np.ndarray, least_cosine: float) -> np.ndarray:
        """Which of the windows at ``at``, ``width`` words wide, the cosine finds near item k. What the space has no place for is near nothing."""
        out = np.zeros(len(at), bool)
        for lo in range(0, len(at), 4096):
            s, index = np.unique(np.stack([at[lo:lo + 4096], width[lo:lo + 4096]]), axis=1, return_inverse=True)
            index = index.ravel()
            word_at, of = _ranges(s[0], np.minimum(s[0] + s[1], end[s[0]]))
            v = np.add.reduceat(space[f[word_at]], np.searchsorted(of, np.arange(s.shape[1])))
            size = np.linalg.norm(v, axis=1)
            dot = np.einsum("ij,ij->i", v[index], items.vectors[k[lo:lo + 4096]])
            out[lo:lo + 4096] = (dot >= least_cosine * size[index]) & (size[index] > 1e-6)
        return out

    for share in np.split(np.arange(len(item)), np.flatnonzero(np.diff(np.cumsum(often) // PLACES)) + 1):
        # an item that the end of a share cuts is taken whole by the share it ends in
        lo, hi = (np.searchsorted(item, item[share[0]]), np.searchsorted(item, item[share[-1]])) if len(share) else (0, 0)
        hi = len(item) if len(share) and share[-1] == len(item) - 1 else hi
        at, of = _ranges(first[word[lo:hi]], first[word[lo:hi]] + often[lo:hi])
        k, pos = item[lo:hi][of], standing[at]
        by = np.argsort(k * len(h) + pos)
        k, pos = k[by], pos[by]
        last = np.arange(len(k)) + least_rare[k] - 1
        whole = last < len(k)
        whole[whole] = k[last[whole]] == k[whole]
        k, a, b = k[whole], pos[whole], pos[last[whole]]
        for width in WINDOWS:
            ok = b - a < skips[k] + 2 * sizes[k] + width
            kk = k[ok]
            s_lo, s_hi = np.searchsorted(start, b[ok] - width - sizes[kk] + 1), np.searchsorted(start, a[ok] + skips[kk] + sizes[kk], "right")
            i, of = _ranges(_apart(kk, s_lo, s_hi), s_hi)
            at, kk = start[i], kk[of]
            hit = near(at, np.full(len(at), width), kk, cosine)
            at, kk = at[hit], kk[hit]
            stop = np.minimum(at + width, end[at])
            look(kk, np.maximum(begin[at], at - skips[kk] - sizes[kk]), np.minimum(end[at], stop + sizes[kk]))
        # passages of the item's own length and one and a half times it, begun by a word of the item
        width = sizes + (sizes + 1) // 2
        ok = (b - a < width[k]) & (skips[k] == 0)
        kk = k[ok]
        s_lo, s_hi = np.maximum(b[ok] - width[kk] + 1, 0), a[ok] + 1
        at, of = _ranges(_apart(kk, s_lo, s_hi), s_hi)
        kk = kk[of]
        own = np.isin(kk * (len(items.vocabulary) + 1) + places[at], items.bag_items * (len(items.vocabulary) + 1) + items.bag_words)
        at, kk = at[own], kk[own]
        fits = enough(kk, at, np.minimum(at + width[kk], end[at]))
        at, kk = at[fits], kk[fits]
        hit = near(at, sizes[kk], kk, cosine) | near(at, width[kk], kk, cosine)
        look(kk[hit], at[hit], np.minimum(at + width[kk], end[at])[hit])
    return found


def _sampled(d: DataFrame, fit_bytes: int) -> DataFrame:
    """About ``fit_bytes`` of the texts of ``d`` (id, text), for callers who bound the fit."""
    total = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rate = 1_000_000 if total <= fit_bytes else max(1, fit_bytes * 1_000_000 // total)
    # with the id, so that copies of one text are sampled one by one; stored once, in few partitions whatever the input
    return written(d.where(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < rate).select("text").repartition(16), "sample")


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, with_answer: float = 0.65, answer: int = 3, fit_bytes: int | None = None, cosine: float = COSINE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, item_ids, shares): one row for each row of ``docs``; ``mark`` is a hash of the text.

    An item leaks where the cosine finds a passage near it in which ``least`` of its words stand in order, or ``with_answer``
    of them together with its last ``answer`` words. Null and empty texts have no leaks, and null or empty items leak nowhere; items with
    null id are left out, equal items count each. Equal rows have equal results. Texts are searched whole, and all of them
    fit the space unless ``fit_bytes`` bounds them. Empty tables
    give no rows or no leaks; other columns don't matter.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("mark"), text.alias("text"))
    texts = d.select("text")
    idf, n_passages = passage_frequencies(texts)
    # each task of the fit gives a whole matrix, so there are no more tasks than cores or than FIT_PASSAGES ask for
    fit = texts.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, n_passages // FIT_PASSAGES)) if fit_bytes is None else _sampled(d, fit_bytes)
    space = latent_space(fit, idf)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    n_items, item_bytes = items.agg(F.count(F.lit(1)), F.coalesce(F.max(F.octet_length("text")), F.lit(0))).first()
    n_blocks = max(1, -(-n_items // ITEM_ROWS), -(-n_items * item_bytes // 64_000_000))
    parts = []
    for block in range(n_blocks):
        own = Items(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect(), space)

        def search(batches, own=own):
            for b in (x for batch in batches for x in B.pieces(batch, "text", PIECE)):
                found = leaks_of(B.Words(b["text"], lower=True), own, space, least, with_answer, answer, cosine)
                ids = [sorted(x) for x in found]
                yield pa.record_batch({
                    "id": b["id"].cast(pa.int64()), "mark": b["mark"], "item_ids": pa.array(ids, pa.list_(pa.int64())),
                    "shares": pa.array([[x[i] for i in k] for x, k in zip(found, ids)], pa.list_(pa.float64())),
                })

        part = d.mapInArrow(search, "id long, mark long, item_ids array<long>, shares array<double>")
        parts.append(part if n_blocks == 1 else written(part, "block_leaks"))  # so that one block is alive at a time
    if n_blocks == 1:
        return parts[0]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    # equal rows are alike in each pass, and one row of each stands for them
    merged = every.dropDuplicates(["id", "mark", "item_ids"]).groupBy("id", "mark").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("item_ids", "shares")))).alias("z"))
    merged = merged.select(F.col("id").alias("i"), F.col("mark").alias("m"), "z")
    return d.join(merged, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m"))).select("id", "mark", F.col("z.item_ids").alias("item_ids"), F.col("z.shares").alias("shares"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item leaks, columns as they were.

    Null and empty texts stay; a row with a null id is judged by its text; of rows with one id, each is judged by its own
    text, and equal rows go or stay together. An empty table stays empty. Columns of any name pass through.
    """
    bad = benchmark_leaks(docs, benchmark).where("size(item_ids) > 0").select("id", "mark").distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["mark"]), "left_anti")


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark items that leak into each document."""
    out = written(benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")), "leaks")
    return out.select(F.col("id").alias("doc_id"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", (F.size("item_ids") > 0).alias("contaminated"))
