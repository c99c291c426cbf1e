"""Ranks of many queries over blocks of postings against every document's score."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from lectern.operators import batch_ranking, retrieval
from lectern.operators.batch_ranking import bm25_batch, write_blocks


def test_blocks_that_cannot_matter_are_passed_over(spark, tmp_path):
    rng = random.Random(3)
    docs = [(i, f"l{i % 6}", [f"l{i % 6}w{int(rng.expovariate(0.08))}" for _ in range(rng.randrange(0, 40))] + ["common"] * (i % 2)) for i in range(900)]
    queries = [(q, [f"l{q % 6}w{int(rng.expovariate(0.08))}" for _ in range(5)] + ["common"] * (q % 3) + ["unknown"]) for q in range(40)] + [(None, ["common"]), (99, []), (98, ["unknown"])]
    path = f"file://{tmp_path}/blocks"
    write_blocks(spark.createDataFrame(docs, "doc_id long, kind string, tokens array<string>").repartition(5), path, ["kind"], per_block=20)
    found, looked = bm25_batch(spark, path, spark.createDataFrame(queries, "query_id long, tokens array<string>"), k=5, first=2)
    mean, df, want = sum(len(t) for _, _, t in docs) / len(docs), Counter(t for _, _, x in docs for t in set(x)), []
    for q, terms in queries:
        scores = []
        for i, _, t in docs:
            tf = Counter(t)
            s = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in terms)
            if q is not None and any(w in tf for w in terms):
                scores.append((-round(s, 6), i))
        want += [(q, r, i) for r, (_, i) in enumerate(sorted(scores)[:5], 1)]
    assert sorted((r.query_id, r.rank, r.doc_id) for r in found.collect()) == sorted(want)
    n = {r.query_id: (r.blocks, r.looked) for r in looked.collect()}
    assert all(b >= k for b, k in n.values()) and sum(k for _, k in n.values()) < 0.6 * sum(b for b, _ in n.values())


def test_postings_move_once_for_all_queries(spark, tmp_path, monkeypatch):
    """Many queries that ask for one frequent token: ties go to the smallest ids, and neither pass makes rows of queries times documents."""
    docs = [(i, ["common"] * (1 + (i % 7 == 0)) + ["x"] * (i % 2)) for i in range(700)]
    queries = [(q, ["common"] * (1 + q % 3)) for q in range(60)]
    path = f"file://{tmp_path}/blocks"
    monkeypatch.setattr(batch_ranking, "QUERIES", 25)
    monkeypatch.setattr(batch_ranking, "BLOCK_TOKENS", 50)
    write_blocks(spark.createDataFrame(docs, "doc_id long, tokens array<string>").repartition(3), path, per_block=100)
    index = spark.read.parquet(f"{path}/blocks")
    assert index.groupBy("block").agg({"n": "max"}).where("`max(n)` > 50").count() == 0 and index.where("token = 'common'").groupBy().sum("n").first()[0] == 700
    found, _ = bm25_batch(spark, path, spark.createDataFrame(queries, "query_id long, tokens array<string>"), k=4, first=2)
    best = sorted(i for i, t in docs if t == ["common"] * 2)[:4]  # two in a document of two tokens
    assert sorted((r.query_id, r.rank, r.doc_id) for r in found.collect()) == [(q, n, i) for q in range(60) for n, i in enumerate(best, 1)]
    asked = spark.createDataFrame([(q, "common", 1.0) for q, _ in queries], "query_id long, token string, weight double")
    pairs = asked.select("query_id").crossJoin(index.select("block").distinct())
    scored = batch_ranking._scored(asked, pairs, index, 4, 1)
    assert scored.count() <= 60 * 8 * index.select("block").distinct().count() < 60 * 700
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no posting is copied for a query


def test_files_of_postings_follow_the_input(spark, tmp_path):
    """A task sorts a bounded share of the postings, also of a token that every document holds."""
    docs = [(i, ["common", "common", f"w{i % 9}"]) for i in range(400)] + [(400, [])]
    retrieval.write_postings(spark.createDataFrame(docs, "doc_id long, tokens array<string>").repartition(3), f"file://{tmp_path}/p", files=2, per_file=100)
    d = spark.read.parquet(f"file://{tmp_path}/p/postings")
    of = d.groupBy(F.input_file_name().alias("file")).count().collect()
    assert len(of) >= 8 and max(r["count"] for r in of) < 200
    assert d.groupBy("token", "tf", "length").count().where("token = 'common'").collect() == [("common", 2, 3, 400)]
    assert sorted((r.doc_id, r.tf, r.length) for r in d.where("token = 'w4'").collect()) == [(i, 1, 3) for i in range(400) if i % 9 == 4]
    assert "Exchange" not in retrieval.postings(spark.createDataFrame(docs, "doc_id long, tokens array<string>"))._jdf.queryExecution().executedPlan().toString()
