"""Table functions in SQL against the expressions and plain Python."""

from difflib import get_close_matches

from pyspark.sql import functions as F

from lectern.functions import chunks, tables
from lectern.functions import text as T

SF = "/root/testdata/sf0.001"


def test_tokens_in_a_lateral_join(spark):
    tables.register(spark)
    spark.createDataFrame([(1, "Deep 点云检索 anomaly-detection 图"), (2, None), (3, "")], "id int, body string").createOrReplaceTempView("bodies")
    got = spark.sql("SELECT id, collect_list(token) AS t FROM bodies, LATERAL tokenize(body) GROUP BY id").collect()
    assert {r.id: r.t for r in got} == {1: ["deep", "anomaly-detection", "点云", "云检", "检索", "图"]}
    spark.read.parquet(f"{SF}/documents.parquet").createOrReplaceTempView("texts")
    d = spark.sql("SELECT doc_id, place, token FROM texts, LATERAL tokenize(text)")
    want = spark.table("texts").select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("place", "token"))
    assert d.exceptAll(want).isEmpty() and d.count() == want.count()
    assert "Python" not in d._jdf.queryExecution().executedPlan().toString()


def test_chunks_and_names_in_lateral_joins(spark):
    tables.register(spark)
    spark.read.parquet(f"{SF}/documents.parquet").createOrReplaceTempView("texts")
    d = spark.sql("SELECT doc_id, chunk_index, chunk FROM texts, LATERAL chunk_paragraphs(text, 300, 40)")
    want = spark.table("texts").select("doc_id", F.posexplode(chunks.paragraph_chunks(F.col("text"), 300, 40)).alias("chunk_index", "chunk"))
    assert sorted(map(tuple, d.collect())) == sorted(map(tuple, want.collect()))
    spark.createDataFrame([(1, "survy", ["survey", "surveys", "syrup", None, "x"]), (2, "q", []), (3, None, ["q"]), (4, "apple", ["ape", "apply"])], "id int, w string, pool array<string>").createOrReplaceTempView("asked")
    got = {}
    for r in spark.sql("SELECT id, rank, name, ratio FROM asked, LATERAL close_matches(w, pool, 2) ORDER BY id, rank").collect():
        got.setdefault(r.id, []).append(r.name)
    assert got == {1: get_close_matches("survy", ["survey", "surveys", "syrup", "x"], n=2), 4: get_close_matches("apple", ["ape", "apply"], n=2)}
