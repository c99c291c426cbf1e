"""Literal cases of the library's operators, each with what it must give."""

import io
import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.functions import chunks as C
from lectern.functions import text as T
from lectern.functions import vectors as V
from lectern.operators import batches, citations, collections, keyed, memory, retrieval, scope
from lectern.plans import context, dag, knowledge, routing, tools
from lectern.scratch import read_version, write_version
from lectern.sources import payloads as P
from lectern.streaming import state

NOW = datetime(2026, 1, 1)


def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def one(spark, column, *values):
    """``column`` of one row of strings a, b, c …"""
    names = "abcdefg"[: len(values)]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names) if values else "a string").select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


# --- texts, chunks, vectors --------------------------------------------------------------------------------------------


def test_text_functions(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, T.normalised_memory(a), "  我偏好  IEEE。 ") == "我偏好 ieee"
    assert one(spark, T.memory_tokens(a), "a ab 异常检测 的 一个") == ["ab", "异常", "常检", "检测"]
    assert one(spark, T.paper_id(F.lit("doi"), a), " 10.1/a b:c ") == "paper:doi:10.1_a_b_c"
    assert one(spark, T.safe_filename(a), "论文 a/b.pdf") == "论文_a_b.pdf" and one(spark, T.safe_filename(a), " ") == "paper.pdf"
    assert one(spark, T.safe_name(a), "..a//b c..") == "a_b_c" and one(spark, T.safe_name(a), "///") == "institution_document"
    assert one(spark, T.html_text(a), "<p>a &amp; b&nbsp;&eacute;</p>") == "a & b\xa0é".replace("\xa0", "\xa0")
    assert one(spark, F.array(*[T.is_arxiv_id(F.lit(x)) for x in ("arXiv:2301.00001v2", "2301.1", "math/0101001")])) == [True, False, False]
    assert one(spark, T.first_paper_id(a), "see paper:arxiv:2301.1-x, ok") == "paper:arxiv:2301.1-x"
    assert one(spark, T.first_link(a), "go https://x.org/a。") == "https://x.org/a" and one(spark, T.first_year(a), "in 1850 or 2025") == "2025"
    assert one(spark, T.repaired(a), "CafÃ©  ok") == "Café ok" and one(spark, T.repaired(a), "naïve ç 登") == "naïve ç 登"
    assert one(spark, T.sentences(a), "One. Two！ ") == ["One", "Two"] and one(spark, T.paragraphs(a), "a\n\n b \n\n\n\n") == ["a", "b"]
    long = "x" * 400 + "y" * 400
    cut = one(spark, T.fitted(a, 100), long)
    assert cut.startswith("x" * 120 + "\n\n[") and cut.endswith("]\n\n" + "y" * 138) and one(spark, T.fitted(a, 400), long) == long
    refs = [one(spark, T.citation(F.lit(s), F.array(a), b, F.lit("arxiv"), F.lit(d).cast("string")), "A", "T") for s, d in (("IEEE", "2024-05"), ("APA", None), ("GB/T 7714", "2020"))]
    assert refs == ['A, "T," arxiv, 2024.', "A (n.d.). T. arxiv.", "A. T[J]. arxiv, 2020."]
    assert one(spark, F.to_json(T.json_object(a)), 'say {"k": [1]} end') == '{"k":[1]}' and one(spark, T.json_object(a).isNull(), "none") is True
    assert [one(spark, T.masked(a), x) for x in ("", "12345678", "123456789")] == ["", "********", "1234...6789"]
    assert [one(spark, T.parsed_time(a).isNull(), x) for x in ("2021", "2021-05", "2021-05-01T00:00:00Z", "no")] == [True, True, False, True]
    assert [one(spark, T.expired(a, b, now()), "active", x) for x in ("2020-01-01T00:00:00", "2030-01-01", "?")] == ["expired", "active", "active"]


def test_chunks(spark):
    text = "第一段内容。\n\n第二段内容。\n\n第三段很长" + "的内容。" * 100
    got = one(spark, C.paragraph_chunks(F.col("a"), 50, 10), text)
    assert any("第一段内容" in c for c in got) and any("第二段内容" in c for c in got) and not any("第一段" in c and "第二段" in c for c in got)
    assert len(one(spark, C.fixed_chunks(F.col("a"), 30, 5), "A" * 100 + " " + "B" * 100)) > 1
    assert one(spark, C.fixed_chunks(F.col("a")), " \n ") == [] == one(spark, C.paragraph_chunks(F.col("a")), " \n\n ")
    words = " ".join(f"w{i}" for i in range(500))
    for size, overlap in ((200, 150), (200, 0), (300, 120)):
        step = size - overlap
        want = [c for c in (words[i:i + size].strip() for i in range(0, len(words), step)) if c]
        assert one(spark, C.fixed_chunks(F.col("a"), size, overlap), words) == want
    paper = spark.createDataFrame([("t", "u", "p", "T", "abs", None, None), ("t", "u", "q", "Only", None, "", None)], "tenant_id string, user_id string, paper_id string, title string, abstract string, full_text string, published_at string")
    rows = {r.paper_id: r for r in C.build_chunks(paper).collect()}
    assert rows["p"].content == "T" and rows["q"].content == "Only" or rows["p"].content == "T abs"


def test_chunk_time_grows_with_length(spark):
    import time

    def seconds(n):
        d = spark.range(1).select(F.repeat(F.lit("ab cd "), n).alias("a")).select(F.size(C.fixed_chunks(F.col("a"))).alias("n"))
        start = time.perf_counter()
        d.collect()
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(400_000) < 8 * max(seconds(100_000), 0.3)


def test_vectors(spark):
    v = one(spark, V.lexical_embedding(F.col("a"), 128), "glacier melt rates")
    assert len(v) == 128 and any(v) and v == one(spark, V.lexical_embedding(F.col("a"), 128), "glacier melt rates")
    q, near, far = (one(spark, V.lexical_embedding(F.col("a"), 256), t) for t in ("river delta", "river delta sediments and tides", "quarterly tax invoices"))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert dot(q, near) > dot(q, far) and not any(one(spark, V.lexical_embedding(F.col("a"), 64), "  "))
    assert one(spark, V.normalised(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8] and one(spark, V.distance_score(F.lit(1.5))) == 0.0


def test_hybrid_ranks_vector_hits_by_place(spark):
    d = spark.createDataFrame([(1, "alpha beta", None, None), (2, "gamma", None, None), (3, "delta", None, None)], "doc_id long, text string, published_at timestamp, indexed_at timestamp")
    d = d.withColumn("tokens", T.tokens(F.col("text")))
    hits = spark.createDataFrame([(2, 1), (1, 2)], "doc_id long, rank int")
    out = {r.doc_id: r for r in retrieval.hybrid(d, hits, ["alpha"], ["gamma"], now(), 5).collect()}
    assert set(out) == {1, 2} and (out[1].vector, out[2].vector) == (0.5, 1.0) and out[1].bm25 == 1.0 and out[2].preference == 1.0
    assert [retrieval.candidate_limit(n) for n in (1, 10, 300)] == [20, 40, 800]


# --- memories ----------------------------------------------------------------------------------------------------------

MEMORY = "memory_id string, tenant_id string, user_id string, memory_type string, content string, normalized_content string, importance double, confidence double, access_count long, last_accessed_at timestamp, status string, created_at timestamp, updated_at timestamp"


def test_memories_are_found_kept_and_recalled(spark):
    m = spark.createDataFrame([("t", "u", "c", 0, "user", "请记住我习惯先看近五年的遥感影像论文，最后按 APA 列出。"), ("t", "u", "c", 1, "assistant", "请记住别的")], "tenant_id string, user_id string, conversation_id string, position int, role string, content string")
    found = memory.extracted(m)
    base = memory.remembered(spark.createDataFrame([], MEMORY), found, now(), ["position", "rule"])
    ask = spark.createDataFrame([("t", "u", "再找几篇遥感影像论文"), ("t", "v", "遥感影像")], "tenant_id string, user_id string, query string")
    got = memory.recalled(base, ask, now()).collect()
    assert any("近五年" in r.content for r in got) and any("APA" in r.content for r in got) and {r.user_id for r in got} == {"u"}
    used = memory.touched(base, memory.recalled(base, ask, now()), now())
    assert {r.access_count for r in used.collect()} == {1}
    gone = memory.forgotten(used, used, now())
    assert memory.recalled(gone, ask, now()).count() == 0 and memory.listed(gone, "t", "u").count() == 0
    again = memory.remembered(gone, found, now(), ["position", "rule"]).collect()
    assert {(r.status, r.access_count) for r in again} == {("active", 1)} and len(again) == base.count()


# --- citations and reports ---------------------------------------------------------------------------------------------


def test_citations(spark):
    texts = spark.createDataFrame([(1, "First [paper:arxiv:2405.00011], then [paper:web:zz9]!"), (2, "only [paper:arxiv:2405.00011]"), (3, None)], "doc int, text string")
    pool = spark.createDataFrame([(1, "paper:arxiv:2405.00011"), (1, "paper:web:zz91"), (2, "paper:arxiv:2405.00011")], "doc int, ref string")
    out = {r.doc: r for r in citations.verified(texts, pool).collect()}
    assert not out[1].is_valid and out[1].hallucinated_ids == ["paper:web:zz9"] and out[1].missing_reference_ids == ["paper:web:zz91"] and out[1].coverage == 0.5
    assert out[2].is_valid and out[2].found_ids == ["paper:arxiv:2405.00011"] and out[2].coverage == 1.0 and out[3].is_valid and out[3].coverage == 0.0
    assert [tuple(r) for r in citations.suggestions(citations.verified(texts, pool), pool).collect()] == [(1, "paper:web:zz9", ["paper:web:zz91"])]
    papers = spark.createDataFrame([("paper:arxiv:2405.00011",), ("x",)], "paper_id string")
    assert citations.cited_papers(texts, papers).count() == 1


def test_reports(spark):
    s = one(spark, citations.section_score(F.col("a"), F.lit(False)), "short")
    assert (s.score, s.passed, len(s.findings)) == (45, False, 2)
    assert one(spark, citations.report_score(F.col("a"), F.lit(True), F.lit(3)), "x").score == 100
    batches = F.array(F.array(*map(F.lit, "abcd")), F.array(*map(F.lit, "ef")))
    assert [list(x.paper_ids) for x in one(spark, citations.outline(batches))] == [["a", "b", "c"], ["a", "b", "e", "f"], ["c", "d", "e", "f"], ["a", "e"]]
    titles = one(spark, citations.outline_titles(F.col("a")), "# Survey Outline: X\n## 1. One\nplain\n2. Two\n### Three\n## Survey outline")
    assert titles == ["One", "Two", "Three"]
    old = F.array(F.struct(F.lit("s1").alias("section_id"), F.lit("o").alias("title"), F.array(F.lit("p")).alias("paper_ids")))
    new = one(spark, citations.edited_outline(old, F.array(F.lit("One"), F.lit("Two"))))
    assert [(x.section_id, x.title, x.paper_ids) for x in new] == [("s1", "One", ["p"]), ("s1", "Two", ["p"])]
    sections = F.array(F.struct(F.lit("T").alias("title"), F.lit(" body ").alias("content")))
    assert one(spark, citations.report_markdown(F.lit("X"), sections, F.array(F.lit("R")))) == "# Survey on X\n\n## T\nbody\n\n## References\n1. R\n"
    assert one(spark, citations.outline_markdown(F.lit("X"), F.array(F.lit("A")))) == "# Survey Outline: X\n## 1. A"
    assert one(spark, citations.template(F.lit("other"), F.lit(""), F.lit(""), F.lit(""), F.lit("p" * 2000))) == "p" * 1200


# --- ordered collections -----------------------------------------------------------------------------------------------


def test_unions_in_order(spark):
    rows = lambda ids: lambda n: spark.createDataFrame([(i, i) for i in ids], "paper_id string, title string").limit(n)

    def broken(n):
        raise RuntimeError("down")

    got, errors = collections.prioritised_union([("local", rows("ab")), ("arxiv", broken), ("crossref", rows("bcd"))], "paper_id", 3)
    assert [r.paper_id for r in got.collect()] == ["a", "b"] and errors == ["arxiv: down"]
    got, _ = collections.prioritised_union([("local", rows("ab")), ("other", broken)], "paper_id", 2)
    assert [r.paper_id for r in got.collect()] == ["a", "b"]
    kind = "conversation string, position int, call_id string, tool_name string, status string"
    messages = spark.createDataFrame([("c", 0, "x", "t", "awaiting_confirmation"), ("c", 1, "", "t", "n"), ("c", 2, "x", "t", "succeeded")], kind)
    ledger = spark.createDataFrame([("c", 0, "x", "t", "failed")], kind)
    events = collections.merged_events(messages, ledger, spark.createDataFrame([("c", 0, "x", "ui", "s")], kind), "conversation").orderBy("place").collect()
    assert [(e.call_id, e.status) for e in events] == [("x", "failed"), ("", "n"), ("x", "s")]


def test_batches_and_places(spark):
    d = spark.createDataFrame([("g", i, n) for i, n in enumerate([3000, 900, 200, 5000, 10])], "g string, i int, n long")
    assert [r.ids for r in batches.batched(d, ["g"], "i", "i", F.col("n")).orderBy("batch").collect()] == [["0", "1"], ["2"], ["3"], ["4"]]
    assert one(spark, collections.chosen_places(F.col("a")), "下载第 三 篇和 2, 99") == [2, 3]
    assert one(spark, collections.chosen_places(F.col("a"), bare=False), "要3篇，还有十条") == [3, 10]
    picks = spark.createDataFrame([("c", [1, 5])], "c string, places array<int>")
    results = spark.createDataFrame([("c", 1, "one")], "c string, place int, title string")
    assert {(r.place, r.title, r.found) for r in collections.at_place(picks, results, "c").collect()} == {(1, "one", True), (5, None, False)}


# --- scopes and guards -------------------------------------------------------------------------------------------------


def test_scopes_and_logins(spark):
    users = spark.createDataFrame([("t", "u", "ann", "x", "active"), ("t", "w", "bob", "x", "off")], "tenant_id string, user_id string, username string, password string, status string").withColumn("password_hash", F.sha2("password", 256))
    tenants = spark.createDataFrame([("t", "T", "active")], "tenant_id string, name string, status string")
    tries = spark.createDataFrame([(1, " ann", "x", None), (2, "ann", "y", None), (3, "bob", "x", None), (4, "ann", "x", "other")], "attempt int, username string, password string, tenant_id string")
    assert {r.attempt: r.user_id for r in scope.login(users, tenants, tries).collect()} == {1: "u", 2: None, 3: None, 4: None}
    keys = scope.key_entries(spark.createDataFrame([("k1234:t:u, bad, k2:t2:u2",)], "v string"), "v")
    assert {tuple(r) for r in keys.collect()} == {("k1234", "t", "u", "k123***"), ("k2", "t2", "u2", "k2***")}
    asked = spark.createDataFrame([("k2",), ("zz",)], "api_key string")
    first = spark.createDataFrame([("k2", "first", "f")], "api_key string, tenant_id string, user_id string")
    assert {(r.api_key, r.tenant_id) for r in scope.users_of_keys(asked, first, keys).collect()} == {("k2", "first"), ("zz", None)}
    d = spark.createDataFrame([("t", "u", "Ä b"), ("t", "v", "x")], "tenant_id string, user_id string, title string")
    assert scope.scoped(d, "t", "u").count() == 1 and scope.found_by(d, "ä", ["title"], [F.col("title")], 5).count() == 1 and scope.found_by(d, "", ["title"], [F.col("title")], 1).count() == 1
    assert scope.filtered(d, user_id="v", tenant_id=None).count() == 1 and scope.among(d, "user_id", ["u"]).count() == 1 == scope.among(d, "user_id", d.where("user_id = 'v'")).count()


def test_guards(spark):
    urls = {"http://127.0.0.1:8080/x": False, "https://x.org/a": True, "ftp://x.org": False, "http://localhost": False, "http://10.1.2.3/": False, "http://172.20.0.1": False, "http://h.local/": False, "": False}
    assert [one(spark, scope.is_public_url(F.col("a")), u) for u in urls] == list(urls.values())
    assert [one(spark, scope.inside(F.col("a"), F.lit("/r/t")), p) for p in ("/r/t/x", "/r/t/../u", "/r/tt", "/r/./t")] == [True, False, False, True]
    assert json.loads(one(spark, scope.redacted(F.col("a")), '{"api_key": "s", "n": {"Token": 1, "ok": [1]}}')) == {"api_key": "[REDACTED]", "n": {"Token": "[REDACTED]", "ok": [1]}}
    assert one(spark, scope.redacted_map(F.create_map(F.lit("api_key"), F.lit("s"), F.lit("r"), F.lit("ok")))) == {"api_key": "[REDACTED]", "r": "ok"}
    assert one(spark, scope.full_text_available(F.lit("doi"), F.lit(None).cast("string"), F.lit(True), F.lit("u"))) is True and one(spark, scope.has_role(F.array(F.lit("tenant_admin")))) is True
    assert one(spark, scope.knowledge_url(F.col("a")), "http://x/a.CAJ") == ""


# --- keyed tables --------------------------------------------------------------------------------------------------------


def test_versions_replace_a_table_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert write_version(spark.range(3), path) == 1
    assert write_version(read_version(spark, path).where("id > 0"), path) == 2
    assert read_version(spark, path).count() == 2 and read_version(spark, path, 1).count() == 3
    (tmp_path / "t" / "v2" / "_SUCCESS").unlink()
    assert read_version(spark, path).count() == 3
    with pytest.raises(ValueError):
        read_version(spark, f"file://{tmp_path}/none")


def test_annotations_and_settings(spark):
    s = "k string, strokes array<struct<page:int,type:string,color:string,points:array<array<double>>,content:string>>, notes string"
    a = spark.createDataFrame([("p", [(2, "pen", "red", [[0.0, 1.0]], None), (None, None, None, None, "c")], "n1")], s)
    rows = keyed.exploded_strokes(a, ["k"])
    assert {(r.page, r.annotation_type, r.content) for r in rows.collect()} == {(2, "pen", ""), (0, "highlight", "c"), (0, "note", "n1")}
    back = keyed.gathered_strokes(rows, ["k"]).first()
    assert [x.page for x in back.strokes] == [0, 2] and back.notes == "n1"
    t = spark.createDataFrame([("A", "1"), ("SECRET", "s"), ("B", "2")], "key string, value string")
    n = spark.createDataFrame([("A", ""), ("SECRET", " "), ("C", "3")], "key string, value string")
    assert {tuple(r) for r in keyed.settings_after(t, n, ["SECRET"]).collect()} == {("SECRET", "s"), ("B", "2"), ("C", "3")}
    assert [one(spark, keyed.as_bool(F.col("a")), x) for x in ("Yes", "0")] == [True, False]


def test_translation_cache_computes_once(spark):
    r = spark.createDataFrame([("t", "u", "p", " a  b ", "zh"), ("t", "v", "p", "a b", "zh")], "tenant_id string, user_id string, paper_id string, source_text string, target_language string")
    empty = spark.createDataFrame([], "tenant_id string, user_id string, paper_id string, source_hash string, target_language string, translated_text string")
    cache = keyed.cache_filled(empty, keyed.looked_up(r, empty, F.lit("done")))
    assert cache.count() == 2 and {x.cached for x in keyed.looked_up(r, cache, F.lit("again")).collect()} == {True}
    assert keyed.cache_filled(cache, keyed.looked_up(r, cache, F.lit("again"))).count() == 2


# --- states and streams ------------------------------------------------------------------------------------------------


def test_cached_calls_and_queues(spark):
    d = spark.createDataFrame([("t", 0, "a", 0.0), ("t", 1, "a", 5.0), ("t", 2, "b", 6.0), ("t", 3, "c", 7.0), ("t", 4, "a", 8.0), ("t", 5, "c", 30.0), ("u", 6, "a", 1.0)], "s string, i int, k string, at double")
    assert {r.i: r.cached for r in state.cached_calls(d, ["s"], ["at"], "k", "at", 10.0, 2).collect()} == {0: False, 1: True, 2: False, 3: False, 4: False, 5: False, 6: False}
    q = spark.createDataFrame([("a", 0, "enqueue"), ("a", 1, "reserve"), ("b", 2, "reserve"), ("b", 3, "ack"), ("b", 4, "reserve"), *[("c", 5 + i, x) for i, x in enumerate(["reserve", "fail"] * 3)]], "job_id string, event_id int, action string")
    assert {(r.job_id, r.status) for r in state.queue_state(q).collect()} == {("a", "unacknowledged"), ("b", "done"), ("c", "dead")}
    assert [r.job_id for r in state.recovered(q).collect()] == ["a"]
    assert one(spark, state.call_signature(F.lit("t"), F.col("a")), "p") != one(spark, state.call_signature(F.lit("u"), F.col("a")), "p")
    assert one(spark, state.frames(F.lit("e"), F.lit("d"))) == "event: e\ndata: d\n\n"
    assert tuple(one(spark, state.observation(F.lit("error")))) == ("span", "ERROR")


def test_sessions_end(spark):
    d = spark.createDataFrame([("a", 0, "started", NOW - timedelta(hours=20)), ("a", 1, "verified", NOW - timedelta(hours=9)), ("b", 0, "verified", NOW), ("c", 0, "verified", NOW), ("c", 1, "revoked", NOW)], "session_id string, event_id int, action string, at timestamp")
    assert {(r.session_id, r.status) for r in state.session_status(d, now()).collect()} == {("a", "expired"), ("b", "active"), ("c", "revoked")}


def test_hourly_stream_passes_over_late_rows_and_goes_on(spark, tmp_path):
    from lectern.streaming.logs import hourly, streamed

    src, schema = f"file://{tmp_path}/in", "ts timestamp, kind string"
    run = lambda: {(r.hour[-2:], r.n) for r in streamed(spark.readStream.schema(schema).json(src), f"file://{tmp_path}/s", lambda e: hourly(e, "ts", "kind", late="1 hour"), ["hour", "kind"]).collect()}
    add = lambda *hours: spark.createDataFrame([(datetime(2026, 1, 1, h), "x") for h in hours], schema).coalesce(1).write.mode("append").json(src)
    add(1, 5)
    assert run() == {("01", 1), ("05", 1)}
    add(5, 1, 6)  # one o'clock is late by now
    assert run() == {("01", 1), ("05", 2), ("06", 1)}


def test_hourly_stream_without_rows(spark, tmp_path):
    from lectern.streaming.logs import hourly, streamed

    spark.createDataFrame([], "ts timestamp, kind string").write.json(f"file://{tmp_path}/in")
    (tmp_path / "in").mkdir(exist_ok=True)
    assert streamed(spark.readStream.schema("ts timestamp, kind string").json(f"file://{tmp_path}/in"), f"file://{tmp_path}/s", lambda e: hourly(e, "ts", "kind"), ["hour", "kind"]).count() == 0


# --- plans ---------------------------------------------------------------------------------------------------------------


def test_waves_send_no_table_through_the_driver(spark, monkeypatch):
    plans, stored = [], dag.stored
    monkeypatch.setattr(dag, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, name))
    n = spark.createDataFrame([(i, [i // 2] if i else []) for i in range(40)], "node_id long, depends_on array<long>")
    assert {r.node_id: r.wave for r in dag.waves(n).collect()} == {i: i.bit_length() for i in range(40)}
    assert len(plans) > 6 and not any("Broadcast" in x for x in plans)


def test_task_graphs(spark):
    nodes = lambda *rows: spark.createDataFrame(rows, "node_id string, depends_on array<string>")
    assert {(r.node_id, r.wave) for r in dag.waves(nodes(("a", []), ("b", ["a"]), ("c", ["a", "b"]))).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert dag.run(nodes(("b", ["a"]), ("a", [])), lambda n, d: n["node_id"] + "".join(d.values())) == ["a", "ba"]
    for bad in (nodes(("a", ["b"])), nodes(("a", ["b"]), ("b", ["a"]))):
        with pytest.raises(ValueError, match="a"):
            dag.waves(bad)
    g = spark.createDataFrame([(1, "a survey", None, 40), (2, " ", None, 0), (3, "note", None, 0)], "k int, goal string, citation_style string, max_papers int")
    assert sorted((r.k, r.node_id) for r in dag.planned(g, "k").collect()) == [(1, "argument_structure"), (1, "citation_policy"), (1, "preflight_critic"), (1, "research_scope"), (3, "argument_structure"), (3, "research_scope")]
    n = nodes(("a", []), ("b", ["a", "x"]))
    got = {r.node_id: r.inputs for r in dag.inputs_of(n, spark.createDataFrame([("a", "1")], "node_id string, result string")).collect()}
    assert got == {"a": {}, "b": None}


def test_routes(spark):
    none = F.lit(None).cast("string")
    r = one(spark, routing.route(F.col("a"), F.lit("survey_review"), none, F.lit(False)), "写一篇知识图谱综述")
    assert (r.target, r.execution_mode) == ("writing_agent", "skill")
    r = one(spark, routing.route(F.col("a"), none, F.lit("cnki"), F.lit(False)), "请对比分析三个方案并形成完整研究综述")
    assert (r.target, r.execution_mode) == ("writing_agent", "delegation") and {"writing_intent", "active_source:cnki"} <= set(r.reasons)
    topics = {"在知网搜图神经网络，返回两篇": "图神经网络", "搜索多模态检索的论文，只返回一篇就好": "多模态检索", "在知网搜索语音合成论文，不要下载": "语音合成", "换成知识图谱，还是下载第二篇": "知识图谱"}
    assert [one(spark, routing.research_topic(F.col("a")), t) for t in topics] == list(topics.values())
    assert one(spark, routing.cleaned_query(F.col("a")), "在知网搜索知识图谱论文，返回三篇") == "知识图谱"
    assert [one(spark, routing.download_refused(F.col("a")), t) for t in ("先不下载", "下载第一篇")] == [True, False]
    assert [one(spark, routing.command(F.col("a")), t) for t in ("连接机构！", "paper:arxiv:1", "hello")] == ["start_institution_login", "search_papers", None]
    tools_ = {"在知网搜索点云": "search_cnki_papers", "删除 paper:a:1": "delete_knowledge", "保存这篇": "search_papers", "天气": None}
    assert [one(spark, routing.deterministic_tool(F.col("a"), none, F.lit(False)), t) for t in tools_] == list(tools_.values())
    assert [one(spark, routing.budget_class(F.col("a")), t) for t in ("刚才做了什么", "完整对比", "下载", "x" * 281, "hi")] == [3000, 7000, 4200, 7000, 2600]
    assert [one(spark, routing.search_source(F.col("a")), t) for t in ("local", "hybrid", "online", "x")] == ["local", "all", "external", "external"]


def test_rules_with_a_chosen_paper(spark):
    none, own = F.lit(None).cast("string"), F.lit("paper:web:7")
    plan = lambda t, last=none, cnki=False, chosen=own: one(spark, F.to_json(routing.deterministic_plan(F.col("a"), last, F.lit(cnki), chosen)), t)
    said = {
        "下载": ("acquire_paper_to_knowledge", {"paper_id": "paper:web:7"}), "入库": ("acquire_paper_to_knowledge", {"paper_id": "paper:web:7"}), "移除": ("delete_knowledge", {"paper_id": "paper:web:7"}),
        "移除 paper:x:1": ("delete_knowledge", {"paper_id": "paper:x:1"}), "验证机构权限 https://a.org/p。": ("verify_institution_access", {"probe_url": "https://a.org/p"}), "paper:q:1": ("search_papers", {"query": "paper:q:1", "source": "local", "limit": "5"}),
        "搜索知识库 图像": ("search_papers", {"query": "图像", "source": "local", "limit": "5"}), "断开机构": ("revoke_institution_session", {}),
    }
    for t, (tool, arguments) in said.items():
        assert json.loads(plan(t)) == {"tool_name": tool, "arguments": arguments}, t
    assert plan("你好") is None and json.loads(plan("移除", chosen=none) or "null") is None
    assert json.loads(plan("下载第三篇和2", cnki=True))["arguments"] == {"indexes": "[2,3]"} and json.loads(plan("搜索语音", cnki=True))["tool_name"] == "search_cnki_papers"
    both = lambda t, cnki=False: one(spark, F.to_json(routing.combined_plan(F.col("a"), F.lit(cnki))), t)
    assert json.loads(both("在知网搜索语音，下载第2篇")) == {"query": "语音", "places": [2]} or both("在知网搜索语音，下载第2篇")
    assert both("搜索语音") is None and both("搜索语音并下载", True) is not None and both("全网搜索语音并下载", True) is None


def test_plans_are_checked(spark):
    d = spark.createDataFrame(
        [(1, "搜索点云并存储知识库", [("search_cnki_papers", {"query": "q", "tenant_id": "t"})]), (2, "搜索", [("search_papers", {}), ("delete_knowledge", {})]), (3, "搜索", [("download_cnki_selections", {})]), (4, "x", None)],
        "i int, content string, steps array<struct<tool_name:string,arguments:map<string,string>>>",
    )
    every = F.array(*[F.lit(x) for x in ("search_cnki_papers", "search_papers", "download_cnki_selections", "delete_knowledge")])
    out = {r.i: [(s.tool_name, s.arguments) for s in r.s] for r in d.select("i", routing.valid_steps(F.col("steps"), F.col("content"), every).alias("s")).collect()}
    assert out == {1: [("search_cnki_papers", {"query": "q"}), ("download_cnki_selections", {"indexes": "1"})], 2: [("search_papers", {})], 3: [], 4: []}
    a = one(spark, routing.search_arguments(F.lit("search_papers"), F.lit(" a "), F.lit("99"), F.lit("Moon")))
    assert (a.query, a.limit, a.source) == ("a", 50, "all")
    args = F.create_map(*[F.lit(x) for kv in {"query": '"q"', "api_key": '"s"', "tenant_id": '"t"', "limit": "5", "obj": "{}", "list": "[1]"}.items() for x in kv])
    assert one(spark, routing.recipe(args)) == {"limit": "5", "list": '"{{list}}"', "query": '"{{query}}"'}
    r = spark.createDataFrame([("t", 0, "a", "succeeded", "x"), ("t", 1, "b", "failed", "y"), ("t", 2, None, "succeeded", "z")], "task string, position int, agent_name string, status string, content string")
    assert routing.delegated_text(r, "task").first().plan == "[a] x\n\n[subagent] z"
    c = spark.createDataFrame([("k1", 0, "one"), ("k2", 1, "two")], "skill_id string, position int, title string")
    assert {(x.n, x.skill_id) for x in routing.catalog_entry(spark.createDataFrame([(1, "k2"), (2, "?")], "n int, skill_id string"), c).collect()} == {(1, "k2"), (2, "k1")}
    s = spark.createDataFrame([("U", "x"), ("K", " ")], "key string, value string")
    assert {tuple(x) for x in routing.configured(s, {"a": ["U"], "b": ["U", "K"]}).collect()} == {("a", True), ("b", False)}


def test_contexts_fit_their_budget(spark):
    msgs = spark.createDataFrame([("c", i, "user" if i % 2 == 0 else "assistant", f"message-{i}") for i in range(14)], "c string, i int, role string, content string")
    p = context.parted(msgs, "c", "i", 4)
    r = p.select("head", "tail", context.summary(F.lit(""), F.col("middle"), F.array().cast("array<string>")).alias("s")).first()
    assert [m.content for m in r.head] == ["message-0", "message-1"] and r.tail[-1].content == "message-13" and "message-5" in r.s and len(r.tail) == 4
    lines = lambda c: F.transform(c, lambda m: context.rendered(m["role"], m["content"]))
    long = spark.createDataFrame([("c", i, "user", f"第 {i} 条消息 " + "长" * 400) for i in range(17)], "c string, i int, role string, content string")
    for d, budget in ((long, 260), (msgs, 3000)):
        q = context.parted(d, "c", "i", 6).select("c", F.lit('{"phase": "idle"}').alias("state"), F.array(F.lit("- [p] m")).alias("memories"), F.lit("s").alias("summary"), F.array(F.lit("e")).alias("events"), lines(F.col("head")).alias("head"), lines(F.col("tail")).alias("tail"), F.lit(budget).alias("budget"))
        out = context.prompts(q, "c").first()
        assert out.tokens <= budget
    assert "message-0" in out.prompt and "message-13" in out.prompt and '"phase": "idle"' in out.prompt
    big = json.dumps({"a": {"b": {"c": {"d": {"e": 1}}}}, "l": list(range(20)), "s": "x" * 3000, "n": None})
    small = json.loads(one(spark, context.compact_json(F.col("a")), big))
    assert small["l"] == list(range(8, 20)) and len(small["s"]) == 1603 and "n" not in small and isinstance(small["a"]["b"]["c"]["d"], str)
    c = context.prepared(spark.createDataFrame([("p" * 90_000, big, 1200)], "prompt string, context string, max_input_tokens int")).first()
    assert c.tokens <= 1300
    titles, blank = F.array(F.lit("T")), F.lit("")
    assert one(spark, context.event_sentence(F.lit("search_papers"), F.lit("succeeded"), blank, titles, blank, blank)) == "检索论文或知识库，状态：succeeded，结果包括：T"
    old = spark.createDataFrame([("c", "a", 2)], "c string, summary string, compression_count int")
    new = spark.createDataFrame([("c", "b", [1]), ("d", "x", [])], "c string, summary string, middle array<int>")
    assert {tuple(x) for x in context.next_snapshot(old, new, ["c"]).collect()} == {("c", "b", 3), ("d", "x", 0)}


def test_tools_and_their_store(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = spark.createDataFrame([("p1", "Cloud points"), ("p2", "Other")], "paper_id string, title string")
    call = lambda name, **a: tools.call(spark, name, tenant_id="t", user_id="u", root=root, **a)
    assert call("save_to_knowledge", rows=rows).count() == 2
    assert [r.paper_id for r in call("search_papers", query="cloud").collect()] == ["p1"]
    assert knowledge.chunks(spark, root).count() == 2
    call("toggle_knowledge_base", ids=["p1"], on=False)
    assert [r.paper_id for r in knowledge.chunks(spark, root).collect()] == ["p2"]
    with pytest.raises(PermissionError):
        call("delete_knowledge", ids=["p1"])
    assert call("delete_knowledge", ids=["p1", "zz"], confirmation_token="yes").count() == 1 and knowledge.papers(spark, root).count() == 1
    assert call("verify_citations", text="[paper:x]").first().is_valid is False
    with pytest.raises(PermissionError):
        tools.call(spark, "search_papers", tenant_id="", user_id="u", root=root)
    assert "delete_knowledge" in {r.name for r in tools.listing(spark).collect()}
    j = spark.createDataFrame([("delete_knowledge", "t", "u", None), ("search_papers", "t", "", None), ("nope", "t", "u", None), ("search_papers", "t", "u", None)], "tool_name string, tenant_id string, user_id string, confirmation_token string")
    assert [r.refused for r in tools.judged(j).orderBy("tool_name", "user_id").collect()] == ["requires human confirmation", "unknown tool", "tenant_id and user_id are required", None]


# --- payloads --------------------------------------------------------------------------------------------------------------


def test_feeds_and_works(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2301.00001v1</id><title>A\n title</title><summary> s </summary><published>2023-01-02T00:00:00Z</published><author><name>N N</name></author></entry><entry><id></id><title>x</title></entry></feed>'
    a = P.arxiv_papers(spark.createDataFrame([(atom,)], "payload string")).collect()
    assert [(r.paper_id, r.title, r.authors, r.abstract, r.published_at) for r in a] == [("paper:arxiv:2301.00001v1", "A title", ["N N"], "s", "2023-01-02")]
    works = {"results": [{"id": "https://openalex.org/W1", "title": " T ", "doi": "https://doi.org/10.1/x", "authorships": [{"author": {"display_name": "A"}}, {"author": {}}], "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "open_access": {"is_oa": True}, "cited_by_count": 3}, {"id": "W2"}]}
    o = P.openalex_papers(spark.createDataFrame([(json.dumps(works),)], "payload string")).collect()
    assert [(r.paper_id, r.doi, r.authors, r.abstract, r.is_oa, r.cited_by_count) for r in o] == [("paper:openalex:10.1_x", "10.1/x", ["A"], "a b a", True, 3)]
    work = {"DOI": "10.1/x", "title": ["T"], "abstract": "<p>a &lt;b&gt; c</p>", "author": [{"given": "G", "family": "F"}, {}], "issued": {"date-parts": [[2024, 5]]}, "published-print": {"date-parts": [[]]}, "is-referenced-by-count": 2}
    rows = [(json.dumps({"message": work}),), (json.dumps({"message": {"items": [work, {"DOI": "y"}]}}),)]
    c = P.crossref_papers(spark.createDataFrame(rows, "payload string")).collect()
    assert {(r.paper_id, r.published_at, tuple(r.authors), r.abstract, r.url) for r in c} == {("paper:doi:10.1_x", "2024-05", ("G F",), "a c", "https://doi.org/10.1/x")} and len(c) == 2
    s = P.synthetic_papers(spark, 3, "arxiv", "q").collect()
    assert [r.paper_id for r in s] == ["paper:arxiv:q", "paper:arxiv:q-1", "paper:arxiv:q-2"] and s[1].published_at == "2021-01-01"


def test_files_of_several_formats(spark, tmp_path):
    doc = io.BytesIO()
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>")
    (tmp_path / "a.docx").write_bytes(doc.getvalue())
    (tmp_path / "b.TXT").write_bytes(b"plain \xff text")
    (tmp_path / "c.txt").write_bytes(b"plain \xff text")
    (tmp_path / "bad.docx").write_bytes(b"zz")
    f = P.files(spark, f"file://{tmp_path}")
    got = {r.title: r for r in P.local_papers(f, "t", "u").collect()}
    assert got["a"].full_text == "one\ntwo" and got["b"].full_text.startswith("plain ") and got["bad"].full_text == "" and got["a"].paper_id.startswith("paper:docx:")
    assert P.distinct_content(f).count() == 3
    ok = spark.createDataFrame([("http://x/ads/1", b"%PDF-1", 3, "t"), ("u", b"zz", 3, "t"), ("u", b"%PDF-1", 1, "1/1"), ("u", b"%PDF-1", 1, "few"), ("u", b"%PDF-1", 9, "text")], "url string, content binary, pages int, text string")
    assert [r[0] for r in ok.select(P.pdf_problem(F.col("url"), F.col("content"), F.col("pages"), F.col("text"))).collect()] == ["PDF_PLACEHOLDER", "PDF_INVALID", "PDF_PLACEHOLDER", "PDF_INCOMPLETE", None]
    assert one(spark, P.author_list(F.col("a")), "A, ,B ") == ["A", "B"]


def test_result_pages(spark):
    html = '<table><tr><td><a href="/kcms2/article/abstract?v=1" title=" 点云 方法 ">x</a></td><td>2025-01</td></tr><tr><td><a href="/kcms2/article/abstract?v=1">again</a></td></tr><tr><td><a href="/other">no result</a></td></tr></table>'
    r = P.result_items(spark.createDataFrame([(1, html)], "page_id int, html string"), "page_id").collect()
    assert [(x.title, x.year, x.position) for x in r] == [("点云 方法", "2025", 1)]
    d = spark.createDataFrame([(1, i, t, "", True) for i, t in enumerate(["CAJ下载", "PDF下载", "原版阅读"])] + [(1, 3, "PDF下载", "/ads/x", True), (1, 4, "PDF下载", "", False)], "k int, index int, text string, href string, visible boolean")
    assert [x.text for x in P.download_order(d, "k").orderBy("try").collect()] == ["PDF下载", "原版阅读", "CAJ下载"]
    assert tuple(one(spark, P.page_signs(F.col("a")), "请登录 captcha")) == (True, True, False)


def test_manifests_and_legacy_files(spark, tmp_path):
    for name, body in (("one", "---\nname: one_skill\nmodule: skills.one\n---\n"), ("off", "---\nname: off_skill\nmodule: skills.off\nenabled: false\n---\n"), ("_x", "---\nname: x_skill\nmodule: skills.x\n---\n"), ("bad", "none")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "SKILL.md").write_text(body)
    m = P.manifests(spark, f"file://{tmp_path}").collect()
    assert [(r.name, r.entrypoint, r.version) for r in m] == [("one_skill", "run_survey_workflow", "0.1.0")]
    at = tmp_path / "annotations" / "t" / "u"
    at.mkdir(parents=True)
    (at / "f.json").write_text('{"paper_id": "p", "strokes": [{"page": 1, "points": [[1, 2]]}], "notes": "n"}')
    (at / "g.json").write_text("{}")
    a = P.legacy_annotations(spark, f"file://{tmp_path}/annotations")
    assert [(r.tenant_id, r.user_id, r.paper_id) for r in a.collect()] == [("t", "u", "p")] and keyed.exploded_strokes(a, ["paper_id"]).count() == 2
    text = one(spark, P.candidate_manifest(F.col("a"), F.lit(None).cast("string"), F.lit('d "q"'), F.lit("{}")), "n")
    assert "enabled: false" in text and 'description: "d \\"q\\""' in text
    P.write_candidates(spark.createDataFrame([("t/1", text)], "tenant_id string, manifest string"), f"file://{tmp_path}/out")
    assert spark.read.text(f"file://{tmp_path}/out").select("tenant_id").distinct().first()[0] == "t_1"


# --- records and surveys ---------------------------------------------------------------------------------------------------


def test_records(spark):
    from lectern.operators import records as R

    d = spark.createDataFrame([(1, '{"a": 1}', None), (2, "no", "x"), (3, None, "")], "k int, j string, t string")
    out = {r.k: r for r in R.decoded_rows(d, {"j": "a int"}, ["t"]).collect()}
    assert out[1].j.a == 1 and out[2].j is None and out[3].t == "" and one(spark, R.decoded(F.col("a"), "map<string,int>", F.create_map(F.lit("d"), F.lit(0))), "") == {"d": 0}
    m = lambda **kw: F.create_map(*[F.lit(x) for kv in kw.items() for x in kv])
    assert one(spark, R.overlaid(m(a="1", b="2"), m(b="3", c="4"))) == {"a": "1", "b": "3", "c": "4"}
    assert one(spark, R.only(m(a="1", b="2"), ["b", "z"])) == {"b": "2"} and one(spark, R.pruned(m(a="[]", b='""', c="0"))) == {"c": "0"}
    assert one(spark, R.navigated(F.col("a"), "$.x.y", "none"), '{"x": {}}') == "none" and one(spark, R.encoded(F.lit(None).cast("struct<a:int>"))) == "{}"
    assert R.with_prefix(d.withColumn("t", F.lit("a_b")), "t", "a_").count() == 3 and R.with_prefix(d.withColumn("t", F.lit("axb")), "t", "a_").count() == 0
    assert R.single(d.where("k = 9")) is None and R.single(d.where("k = 1"))["k"] == 1
    log = spark.createDataFrame([("r", None, 0, "running"), ("r", None, 2, "done"), ("c", "r", 1, "failed")], "run_id string, parent_run_id string, event_id int, status string")
    assert {(r.run_id, r.status, r.depth) for r in R.runs(log).collect()} == {("r", "done", 0), ("c", "failed", 1)}
    assert [tuple(r) for r in R.children(R.runs(log)).collect()] == [("r", "c", "failed")]
    assert [e.status for e in R.events_in_order(log, ["run_id"], "event_id", ["status"]).where("run_id = 'r'").first().events] == ["running", "done"]
    assert R.last_matching(log, ["run_id"], "event_id", F.col("status") == "running", ["status"]).count() == 1
    assert tuple(R.tally(log, failed=F.col("status") == "failed", none=F.col("parent_run_id") == "r").first()) == (3, 1, 1)
    assert one(spark, R.latency_ms(now(), now() + F.expr("INTERVAL 1500 MILLISECONDS"))) == 1500
    tasks = spark.createDataFrame([("t", "completed", json.dumps({"citation_audit": {"is_valid": True, "coverage": 0.5, "hallucinated_ids": ["x"]}, "papers": [{"paper_id": "p", "title": "T"}], "reflections": [{"section_id": "s", "score": 90}]})), ("u", "failed", None)], "task_id string, status string, result_json string")
    papers, audit, reviews = R.artifacts(tasks)
    assert {tuple(r) for r in audit.collect()} == {("t", "completed", True, 0.5, 1), ("u", "failed", False, 0.0, 0)} and papers.count() == 1 == reviews.count()
    t, u = R.demo_accounts(spark, [("t", "T")], [("u", "t", "ann", "x")])
    assert scope.logins(u, t).count() == 1 and "password" not in u.columns


def test_survey_from_papers_to_report(spark):
    from lectern.plans import survey

    topics = spark.createDataFrame([(1, "clouds"), (2, "nothing")], "topic_id int, topic string")
    papers = spark.createDataFrame([(1, i, f"paper:x:{i % 4}", f"Title {i}", "a" * 9000, ["A"], "arxiv", "2024-01-01") for i in range(6)], "topic_id int, position int, paper_id string, title string, abstract string, authors array<string>, source string, published_at string")
    out = {r.topic_id: r for r in survey.surveys(topics, papers).collect()}
    assert out[1].is_valid and out[1].passed and "# Survey on clouds" in out[1].markdown and '1. A, "Title 4," arxiv, 2024.' in out[1].markdown and not out[2].passed
    attempts = []

    def write(todo, outline, attempt):
        attempts.append(attempt)
        d = survey.drafts(todo, outline)
        return d if attempt else d.withColumn("content", F.lit("bad [paper:unknown]"))

    assert {r.topic_id: r.passed for r in survey.surveys(topics, papers, write).collect()} == {1: True, 2: False} and attempts == [0, 1]
    assert survey.progress(topics).where("event = 'completed'").count() == 2
