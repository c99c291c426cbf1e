"""Ranked retrieval: BM25, vector ranks, time decay and preference overlap, fused by weights.

A query is a handful of terms. Texts are tokenised once; what is kept of them for a query is their length, the counts
of its terms and the overlap with preferences, a few numbers a row. Term statistics of the corpus are one aggregate row
and go into the scoring expression as literals; only the top k of each partition meet. Where many queries meet one
corpus, ``write_postings`` stores tokens once, and a query reads those of its own terms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import decay, once, tokens
from lectern.functions.vectors import cosine
from lectern.scratch import stored

# The saturation and length weights of BM25, the weights of the four scores, and the cap on candidates.
K1, B = 1.5, 0.75
WEIGHTS = {"vector": 0.35, "bm25": 0.40, "temporal": 0.10, "preference": 0.15}
CANDIDATES = 800
#: Tokens whose postings one task sorts, some 100 MB.
FILE_TOKENS = 1_500_000
# Memories of these types make preferences.
PREFERENCE_TYPES = ("preference", "profile", "constraint", "instruction")


def candidate_limit(limit: int, most: int = CANDIDATES) -> int:
    return min(max(limit * 4, 20), max(most, limit))


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("tokens"))


def _idf(n: int, df: int) -> Column:
    return F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5)))


def _saturated(tf: Column, length: Column, mean: float) -> Column:
    return (tf * (K1 + 1)) / (tf + K1 * (F.lit(1 - B) + B * length / mean))


def _is(term: str):
    return lambda x: x == F.lit(term)


def term_counts(docs: DataFrame, query: list[str], preferences: list[str] = (), token_col: str = "tokens") -> DataFrame:
    """``docs`` with ``length``, ``tf`` (a count for each distinct term, sorted) and ``shared`` (distinct preferences
    that stand in it) in place of their tokens."""
    terms, own = sorted(set(query)), sorted(set(preferences))
    tf = F.array(*[F.size(F.filter(token_col, _is(t))) for t in terms]) if terms else F.array().cast("array<int>")
    shared = F.size(F.array_intersect(token_col, F.array(*[F.lit(p) for p in own]))) if own else F.lit(0)
    return docs.withColumns({"length": F.size(token_col), "tf": tf, "shared": shared}).drop(token_col)


def bm25(docs: DataFrame, query: list[str], token_col: str = "tokens", out: str = "bm25") -> DataFrame:
    """Adds Okapi BM25 of the query's terms to ``docs``, whose tokens go; repeated terms count each time they stand.

    Statistics cover all rows, those without tokens too. No query or no rows give zeros.
    """
    terms = sorted(set(query))
    d = stored(term_counts(docs, query, token_col=token_col), "terms")
    stats = d.agg(F.count(F.lit(1)), F.coalesce(F.avg("length"), F.lit(0.0)), *[F.coalesce(F.sum((F.get("tf", F.lit(i)) > 0).cast("long")), F.lit(0)) for i in range(len(terms))]).first()
    n, mean = stats[0], max(float(stats[1]), 1.0)
    part = [_idf(n, stats[2 + i]) * _saturated(F.get("tf", F.lit(i)).cast("double"), F.col("length"), mean) for i in (terms.index(t) for t in query)]
    return d.withColumn(out, reduce(lambda a, b: a + b, part, F.lit(0.0))).drop("tf", "length", "shared")


def _counts(tokens: Column) -> Column:
    """(token, tf) of an array: runs of the sorted array."""
    def runs(s: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i == 0) | (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1)))
        return once(at, lambda at: F.transform(F.slice(at, 1, F.size(at) - 1), lambda i, k: F.struct(F.get(s, i).alias("token"), (F.get(at, k + 1) - i).alias("tf"))))

    return F.when(F.size(tokens) > 0, once(F.sort_array(tokens), runs))


def postings(docs: DataFrame) -> DataFrame:
    """(token, doc_id, tf, length) of ``docs`` (doc_id, tokens): counted inside the row, so nothing moves or is held for it."""
    d = docs.select("doc_id", F.size("tokens").alias("length"), F.explode(_counts(F.col("tokens"))).alias("t"))
    return d.select("t.token", "doc_id", "length", F.col("t.tf").cast("long").alias("tf"))


def write_postings(docs: DataFrame, path: str, files: int = 200, per_file: int = FILE_TOKENS) -> None:
    """Postings under ``path``, in order of token, so that a query's terms are a few row groups; and the corpus's size. There are
    more than ``files`` files where one would get over ``per_file`` tokens, and a frequent token is spread over several."""
    d = stored(docs.select("doc_id", "tokens"), "tokens")
    total = d.agg(F.sum(F.size("tokens"))).first()[0] or 0
    postings(d).repartitionByRange(max(files, -(-total // per_file)), "token", "doc_id").sortWithinPartitions("token", "doc_id").write.parquet(f"{path}/postings")
    d.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("mean")).write.parquet(f"{path}/size")


def bm25_of_postings(spark, path: str, query: list[str]) -> DataFrame:
    """(doc_id, bm25) of the documents that hold a term of the query; token filters reach the Parquet scan."""
    size = spark.read.parquet(f"{path}/size").first()
    times = {t: query.count(t) for t in query}
    d = spark.read.parquet(f"{path}/postings").where(F.col("token").isin(*times))
    df = {r["token"]: r["n"] for r in d.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    score = F.lit(0.0)
    for t, n in df.items():
        score = F.when(F.col("token") == t, times[t] * _idf(size["n"], n)).otherwise(score)
    d = d.select("doc_id", (score * _saturated(F.col("tf").cast("double"), F.col("length"), max(size["mean"], 1.0))).alias("s"))
    return d.groupBy("doc_id").agg(F.sum("s").alias("bm25"))


def vector_top(vectors: DataFrame, query: list[float], limit: int, id_cols: tuple[str, ...] = ("doc_id",), vector_col: str = "embedding") -> DataFrame:
    """(*id, cosine, rank): the nearest rows by cosine, rank 1 first, ties to the smaller id. Rows without length are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    best = vectors.select(*id_cols, cosine(F.col(vector_col), q).alias("cosine")).where("cosine is not null").orderBy(F.desc("cosine"), *id_cols).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cosine"), *id_cols)))  # of ``limit`` rows


def preference_tokens(memories: DataFrame) -> list[str]:
    """The distinct tokens of recalled memories that say what a user prefers; a recall is a few rows."""
    rows = memories.where(F.col("memory_type").isin(*PREFERENCE_TYPES)).select(F.explode(tokens(F.col("content"))).alias("t")).distinct().collect()
    return sorted(r["t"] for r in rows)


def hybrid(
    docs: DataFrame, hits: DataFrame, query: list[str], preferences: list[str], now: Column, limit: int = 10, half_life: float = 365.0, weights: dict[str, float] | None = None,
    id_cols: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The best of ``docs`` (*id, tokens, published_at, indexed_at), given ``hits`` (*id, rank) of a vector search.

    Rows with no BM25 score and no rank are no candidates. Scores are 1 / rank, BM25 over its largest, decay of the
    published or else the indexed time, and the share of preferences that stand in the text. Order: the weighted sum
    before rounding, then the newer index time, then the id. What comes out is rounded to six digits.
    """
    w = WEIGHTS | (weights or {})
    d = term_counts(docs.select(*id_cols, "tokens", "published_at", "indexed_at"), query, preferences)
    terms, own = sorted(set(query)), len(set(preferences))
    d = stored(d, "terms")
    stats = d.agg(F.count(F.lit(1)), F.coalesce(F.avg("length"), F.lit(0.0)), *[F.coalesce(F.sum((F.get("tf", F.lit(i)) > 0).cast("long")), F.lit(0)) for i in range(len(terms))]).first()
    n, mean = stats[0], max(float(stats[1]), 1.0)
    part = [_idf(n, stats[2 + i]) * _saturated(F.get("tf", F.lit(i)).cast("double"), F.col("length"), mean) for i in (terms.index(t) for t in query)]
    d = d.withColumn("bm25", reduce(lambda a, b: a + b, part, F.lit(0.0)))
    best = d.agg(F.max("bm25")).first()[0] or 0.0
    d = d.join(F.broadcast(hits.select(*id_cols, "rank")), list(id_cols), "left").where("bm25 > 0 or rank is not null")  # at most candidate_limit rows
    d = d.withColumns({
        "vector": F.coalesce(1.0 / F.col("rank"), F.lit(0.0)), "bm25": F.col("bm25") / best if best else F.lit(0.0),
        "temporal": decay(F.coalesce("published_at", "indexed_at"), now, half_life), "preference": F.col("shared") / own if own else F.lit(0.0),
    })
    d = d.withColumn("__score", reduce(lambda a, b: a + b, [w[k] * F.col(k) for k in WEIGHTS]))
    d = d.orderBy(F.desc("__score"), F.desc_nulls_last("indexed_at"), *id_cols).limit(limit)
    return d.select(*id_cols, *[F.round(k, 6).alias(k) for k in WEIGHTS], F.round("__score", 6).alias("score"))


def enriched(results: DataFrame, papers: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``results`` with columns of their papers, blank where a paper is unknown."""
    d = results.join(papers.select(*key, *columns), key, "left")
    return d.withColumns({c: F.coalesce(c, F.lit("")) for c in columns})


def index_stats(chunks: DataFrame, key: list[str], paper: str) -> DataFrame:
    """Chunks and papers of each scope."""
    return chunks.groupBy(*key).agg(F.count(F.lit(1)).alias("chunk_count"), F.countDistinct(paper).alias("paper_count"))
