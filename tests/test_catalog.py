"""Every query of the catalogue against its SQL, and the literal cases of the operators."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern import catalog, catalog_live, catalog_more, catalog_rules
from lectern.functions import text as T
from lectern.operators import relational as R
from lectern.operators.retrieval import bm25
from lectern.sources.stored import append_lines, document_kind, keyed_json, text_of_positions
from lectern.streaming.logs import rate_limited

SF = "/root/testdata/sf0.001"


def same(spark, name, queries, sql):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df = queries[name](spark, SF)
    got = con.execute(sql[name])
    columns = [c[0] for c in got.description]
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(norm(v) for v in r) for r in got.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr) == want


QUERIES, SQL = catalog.QUERIES | catalog_more.QUERIES | catalog_live.QUERIES | catalog_rules.QUERIES, catalog.ORACLE_SQL | catalog_more.ORACLE_SQL | catalog_live.ORACLE_SQL | catalog_rules.ORACLE_SQL | {k: catalog.ORACLE_SQL[v] for k, v in catalog_more.SAME_AS.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    same(spark, name, QUERIES, SQL)


def test_bm25_scores_only_matching_texts(spark):
    d = spark.createDataFrame([(0, "anomaly anomaly detection in data streams"), (1, "database repair and data quality")], "doc_id long, text string")
    out = {r.doc_id: r.bm25 for r in bm25(d.withColumn("tokens", T.tokens(F.col("text"))), ["anomaly", "detection"]).collect()}
    assert out[0] > out[1] == 0.0


def test_text_expressions(spark):
    d = spark.createDataFrame([("A-b c 点云图 图", "see [paper:arxiv:1] and [paper:x]"), (None, None)], "t string, c string")
    a, b = d.select(T.tokens(F.col("t")).alias("t"), T.cited(F.col("c")).alias("c")).collect()
    assert a.t == ["a-b", "c", "点云", "云图", "图"] and a.c == ["paper:arxiv:1", "paper:x"]
    assert b.t == [] and b.c == []


def test_decay_halves_in_a_half_life(spark):
    now = F.lit("2026-01-01").cast("timestamp")
    r = spark.range(1).select(T.decay(now, now, 100).alias("a"), T.decay(now - F.expr("INTERVAL 100 DAYS"), now, 100).alias("b"), T.decay(F.lit(None).cast("timestamp"), now, 100).alias("c")).first()
    assert (round(r.a, 9), round(r.b, 9), r.c) == (1.0, 0.5, 0.0)


def test_keyed_tables(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k long, v string")
    delta = spark.createDataFrame([(2, "d"), (3, "e")], "k long, v string")
    assert sorted(map(tuple, R.upsert(base, delta, ["k"]).collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, R.replace_all(base, delta, ["k"]).collect())) == [(1, "a"), (2, "d"), (3, "e")]
    log = spark.createDataFrame([(0, "x", "old"), (1, "y", "one"), (2, "x", "new")], "pos long, id string, v string")
    assert sorted(map(tuple, R.first_position_last_value(log, ["id"], "pos", ["v"]).collect())) == [("x", 0, "new"), ("y", 1, "one")]
    assert {r.v for r in R.first_wins(log, [F.col("id")], ["pos"]).collect()} == {"old", "one"}


def test_admission_counts_only_admitted_rows(spark):
    rows = [
        (0, "a", 0.0), (1, "a", 1.0), (2, "a", 5.0), (3, "a", 10.0), (4, "a", 11.0), (5, "b", 0.0), (6, None, 3.0), (7, "a", None)]
    out = rate_limited(spark.createDataFrame(rows, "i long, k string, t double"), "k", F.col("t"), ["i"], limit=2, window=10.0)
    # at 10 the rows of 0 and 1 still count; at 11 that of 0 doesn't
    assert {r.i: r.allowed for r in out.collect()} == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: False, 7: False}


def test_admitted_events_agree_with_a_loop(spark):
    kept, want = {}, {}
    for r in sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda r: (r.ts, r.event_id)):
        own = [t for t in kept.get(r.user_id, []) if (r.ts - t).total_seconds() <= 86_400]
        want[r.event_id] = len(own) < 2
        kept[r.user_id] = own + [r.ts] * want[r.event_id]
    assert {r.event_id: r.allowed for r in catalog.QUERIES["admitted_events"](spark, SF).collect()} == want


def test_stored_payloads(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": {"n": 1, "t": "one"}, "y": {"n": 2}}')
    assert sorted(map(tuple, keyed_json(spark, str(tmp_path / "a.json"), "n int, t string").collect())) == [("x", 1, "one"), ("y", 2, None)]
    for _ in range(2):
        append_lines(spark.range(2), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    d = spark.createDataFrame([(b"%PDF-1.7",), (b"HZKJ..",), (b"<!DOCTYPE html><p>Login</p>",), (b"<html>x",), (b"zz",), (None,)], "c binary")
    assert [r[0] for r in d.select(document_kind(F.col("c"))).collect()] == ["pdf", "caj", "login", "page", "unknown", "unknown"]
    m = spark.createDataFrame([({"b": [1, 3], "a": [0, 2]},)], "m map<string, array<int>>")
    assert m.select(text_of_positions(F.col("m"))).first()[0] == "a b a b"
