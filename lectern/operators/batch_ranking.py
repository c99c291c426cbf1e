"""BM25 for a table of queries over stored postings, with whole blocks of documents passed over by their largest scores.

``write_blocks`` cuts the documents into blocks of about ``PER_BLOCK`` neighbours in some order and stores, for each token and
block, the documents' parts of the score and the largest of them. For a query, the sum of its terms' largest parts is more
than any document of the block can score. The blocks with the highest bounds are scored first; what the k-th document there
has, every other block's bound must reach, or the block isn't read. A block meets all queries that need it in one group
(``QUERIES`` of them, more make more groups), so that a posting moves once for all of them, and what leaves the group is each
query's few best documents: neither queries times postings nor queries times documents are ever rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lectern.operators.retrieval import B, K1
from lectern.scratch import stored

PER_BLOCK = 1024
FIRST = 4
#: Scores are equal below this.
DIGITS = 6
#: Tokens that a block holds at most, but for one document's, and queries that meet a block in one group.
BLOCK_TOKENS, QUERIES = 2_000_000, 1000
#: What no token may hold.
SEPARATOR = "\0"


def _postings_of(ids: pa.Array, tokens: pa.Array, block: int, mean: float) -> pa.RecordBatch:
    """A block's rows of the index, in order of token."""
    length = pc.list_value_length(tokens).to_numpy().astype(np.int64)
    words = pc.list_flatten(tokens)
    known = words.unique()
    known = known.take(pc.sort_indices(known))
    key = pc.index_in(words, known).to_numpy(zero_copy_only=False).astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), length)
    key, tf = np.unique(key, return_counts=True)
    term, doc = key // max(len(ids), 1), key % max(len(ids), 1)
    part = (tf * (K1 + 1)) / (tf + K1 * ((1 - B) + B * length[doc] / mean))
    cut = np.searchsorted(term, np.arange(len(known) + 1))
    docs = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([ids.take(pa.array(doc)), pa.array(part)], ["doc_id", "part"]))
    most = np.maximum.reduceat(part, cut[:-1]) if len(known) else np.zeros(0)
    return pa.record_batch({"token": known, "block": pa.array(np.full(len(known), block, np.int64)), "most": pa.array(most), "n": pa.array(np.diff(cut).astype(np.int64)), "docs": docs})


def write_blocks(docs: DataFrame, path: str, order: list[str] = (), per_block: int = PER_BLOCK) -> None:
    """Postings of ``docs`` (doc_id, tokens, *order) by token and block. Neighbours in ``order`` should be alike: the more the
    blocks' largest parts differ, the more of them are passed over. Documents without tokens count in the statistics."""
    by = [*order, "doc_id"]
    d = stored(docs.select(*dict.fromkeys(by), "tokens"), "tokens")  # texts are cut into tokens once
    n, mean = d.agg(F.count(F.lit(1)), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0))).first()
    mean = max(float(mean), 1.0)
    # a block's documents lie in one partition, so its postings are put together there and don't move
    # they move as one string, which takes a fraction of an array's room
    d = d.where(F.size("tokens") > 0).select(*dict.fromkeys(by), F.size("tokens").alias("__n"), F.array_join("tokens", SEPARATOR, "").alias("__words"))
    d = d.repartitionByRange(max(1, -(-n // per_block)), *by).select(F.spark_partition_id().alias("part"), "doc_id", F.col("__n").alias("n"), F.col("__words").alias("words"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, block = [], 0, 0
        for b in batches:
            length = b["n"].to_numpy()
            piece = (size + np.cumsum(length, dtype=np.int64)) // BLOCK_TOKENS
            cuts = np.r_[0, np.flatnonzero(np.diff(piece)) + 1, len(piece)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo and held:
                    yield together(held, block)
                    held, size, block = [], 0, block + 1
                if hi > lo:
                    held.append(b.slice(lo, hi - lo))
                    size += int(length[lo:hi].sum())
        if held:
            yield together(held, block)

    def together(held: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        ids, words = (pa.concat_arrays(t[c].chunks) for c in ("doc_id", "words"))
        tokens = pc.split_pattern(words, SEPARATOR)
        if not pc.list_value_length(tokens).equals(t["n"].combine_chunks().cast(pc.list_value_length(tokens).type)):
            raise ValueError("a token holds U+0000")
        return _postings_of(ids, tokens, t["part"][0].as_py() * 2**32 + block, mean)

    docs_type = StructType([StructField("doc_id", d.schema["doc_id"].dataType), *StructType.fromDDL("part double")])
    kind = f"token string, block long, most double, n long, docs array<{docs_type.simpleString()}>"
    d.mapInArrow(index, kind).write.option("compression", "zstd").parquet(f"{path}/blocks")
    df = docs.sparkSession.read.parquet(f"{path}/blocks").groupBy("token").agg(F.sum("n").alias("df"))
    df.select("token", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")).write.parquet(f"{path}/terms")


def _asked(spark, path: str, queries: DataFrame, name: str) -> DataFrame:
    q = queries.select("query_id", F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))
    return stored(q.join(spark.read.parquet(f"{path}/terms"), "token").select("query_id", "token", (F.col("times") * F.col("idf")).alias("weight")), name)


def _best_of(w: pa.Table, p: pa.Table, k: int) -> pa.Table:
    """(query_id, doc_id, bm25) of one block, for ``w`` (query_id, token, weight) and ``p`` (token, docs): each query's ``k`` best
    by score to DIGITS, ties to the smaller id, and whatever rounding could put among them."""
    docs = pa.concat_arrays(p["docs"].chunks) if p.num_rows else pa.array([], p.schema.field("docs").type)
    start = np.r_[0, np.cumsum(pc.list_value_length(docs).to_numpy(zero_copy_only=False))].astype(np.int64)
    flat = pc.list_flatten(docs)
    ids, part = flat.field(0), flat.field(1).to_numpy(zero_copy_only=False)
    known = ids.unique()
    known = known.take(pc.sort_indices(known))
    doc = pc.index_in(ids, known).to_numpy(zero_copy_only=False)
    w = w.filter(pc.is_in(w["token"], value_set=p["token"])).sort_by("query_id")
    term = pc.index_in(w["token"], value_set=p["token"]).to_numpy()
    weight = w["weight"].to_numpy()
    queries = w["query_id"].unique()
    of = pc.index_in(w["query_id"], queries).to_numpy()
    ends = np.searchsorted(of, np.arange(len(queries)), "right")
    found, scores, many = [], [], []
    for lo, hi in zip([0, *ends.tolist()], ends.tolist()):
        size = start[term[lo:hi] + 1] - start[term[lo:hi]]
        at = np.arange(size.sum()) + np.repeat(start[term[lo:hi]] - np.cumsum(size) + size, size)
        score = np.bincount(doc[at], weights=part[at] * np.repeat(weight[lo:hi], size), minlength=len(known))
        own = np.flatnonzero(np.bincount(doc[at], minlength=len(known)))
        if len(own) > k:
            own = own[score[own] >= np.partition(score[own], -k)[-k] - 2 * 10.0 ** -DIGITS]
        own = own[np.argsort(-score[own], kind="stable")]
        # of equal scores, the k smallest ids
        first = np.flatnonzero(np.r_[True, np.diff(score[own]) != 0])
        own = own[np.arange(len(own)) - np.repeat(first, np.diff(first, append=len(own))) < k]
        found.append(own)
        scores.append(score[own])
        many.append(len(own))
    at = np.concatenate(found) if found else np.zeros(0, np.int64)
    return pa.table({"query_id": queries.take(pa.array(np.repeat(np.arange(len(many)), many), pa.int64())), "doc_id": known.take(pa.array(at, pa.int64())), "bm25": pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())})


def _scored(asked: DataFrame, pairs: DataFrame, blocks: DataFrame, k: int, shards: int) -> DataFrame:
    """(query_id, doc_id, score) of the best documents of each of ``pairs`` (query_id, block)."""
    pairs = pairs.select("query_id", "block", F.pmod(F.xxhash64("query_id"), F.lit(shards)).alias("shard"))
    terms = pairs.join(asked, "query_id").select("block", "shard", "query_id", "token", "weight")
    posts = blocks.select("token", "block", "docs").join(asked.select("token").distinct(), "token", "left_semi").join(pairs.select("block", "shard").distinct(), "block")
    out = StructType([asked.schema["query_id"], StructField("doc_id", blocks.schema["docs"].dataType.elementType["doc_id"].dataType), *StructType.fromDDL("bm25 double")])
    posts = posts.select(F.col("block").alias("b"), F.col("shard").alias("s"), "token", "docs").groupBy("b", "s")
    d = terms.groupBy("block", "shard").cogroup(posts).applyInArrow(lambda w, p: _best_of(w, p, k), out)
    return d.select("query_id", "doc_id", F.round("bm25", DIGITS).alias("score"))


def bm25_batch(spark, path: str, queries: DataFrame, k: int = 10, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """((query_id, rank, doc_id, score), (query_id, blocks, looked)): the ``k`` best documents of each of ``queries`` (query_id,
    tokens) by score to six digits, ties to the smaller id, and how many blocks hold its terms and were scored.

    Repeated terms count each time. Documents with none of the terms have no rank. Null ids of queries are left out.
    """
    asked = _asked(spark, path, queries.where("query_id IS NOT NULL"), "asked")
    blocks = spark.read.parquet(f"{path}/blocks")
    bounds = asked.join(blocks.select("token", "block", "most"), "token").groupBy("query_id", "block").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"))
    best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    bounds = stored(bounds.withColumn("place", F.row_number().over(best)), "bounds")
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    shards = max(1, -(-asked.select("query_id").distinct().count() // QUERIES))
    scores = _scored(asked, bounds.where(F.col("place") <= first), blocks, k, shards)
    ranked = stored(scores.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k), "first_scores")
    kth = ranked.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    rest = bounds.where(F.col("place") > first).join(kth, "query_id", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - 10.0 ** -DIGITS))
    rest = stored(rest.select("query_id", "block"), "rest")
    out = ranked.select("query_id", "doc_id", "score").unionByName(_scored(asked, rest, blocks, k, shards))
    out = out.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    looked = bounds.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("place") <= first).alias("n")).join(rest.groupBy("query_id").agg(F.count(F.lit(1)).alias("m")), "query_id", "left")
    return out.select("query_id", "rank", "doc_id", "score"), looked.select("query_id", "blocks", (F.col("n") + F.coalesce("m", F.lit(0))).alias("looked"))
