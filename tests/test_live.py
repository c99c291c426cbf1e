"""Keyed state: conversations, sessions and caches, as tables and as streams with a restart in between, against plain Python."""

import json
import random
from collections import OrderedDict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.streaming import conversations as C
from lectern.streaming import expiry, queue
from lectern.streaming.logs import rate_limited
from lectern.streaming.state import cached_calls, folded


@pytest.fixture
def keyed(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    expiry.use_keyed_state(spark)
    yield spark
    spark.conf.set(name, before)


def run(stream, path):
    """The rows of a stream of everything that its source has now, in order of batches."""
    got = []
    q = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: got.extend(r.asDict(recursive=True) for r in b.collect())).option("checkpointLocation", f"file://{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return got


def some_events(rng, n):
    tools = [*C.CLASSES, "show_paper", ""]
    for _ in range(n):
        kind = rng.choice(["user", "route", "clear", "tool", "tool", "tool", "tool", "?"])
        e = {"kind": kind, "content": rng.choice([" goal ", None, "x" * 1200]), "confidence": rng.choice([2, -1, 0.12345, None]), "intent": "i", "tool_name": rng.choice(tools), "call_id": rng.choice(["a", "b", "", None]), "error": rng.choice(["bad", "", None])}
        e |= {"status": rng.choice(["awaiting_confirmation", "succeeded", "failed", "cancelled", "running", None]), "arguments": {"query": rng.choice(["q1", "q2"]), "source": rng.choice(["arxiv", ""]), "tenant_id": "t"}}
        e["result"] = {"items": [{"paper_id": f"p{rng.randrange(60)}", "title": "T", "year": 2020} for _ in range(rng.randrange(25))] + ["no paper", {"title": "no id"}], "error": "inner", **({"paper": {"paper_id": "single"}} if rng.random() < 0.3 else {})}
        yield {k: v for k, v in e.items() if v is not None}


def plain(events):
    """The state after each event, and the papers at the end, by a loop."""
    s, papers, out = dict(C.START) | {"pending": None}, [], []
    for e in events:
        tool, status, won = e.get("tool_name", ""), e.get("status"), e.get("status") == "succeeded"
        if e.get("kind") == "user":
            s |= {"goal": e.get("content", "").strip(" ")[:1000], "phase": "planning", "error": ""}
        if e.get("kind") == "clear":
            s |= {"phase": "idle", "pending": None}
        if e.get("kind") == "route":
            s["route"] = round(min(max(e.get("confidence", 0), 0), 1), 3)
        if e.get("kind") == "tool":
            if tool.startswith("search"):
                s |= {"domain": "literature", "source": "cnki" if "cnki" in tool else e["arguments"]["source"] or "all", "query": e["arguments"]["query"], "phase": "selection_ready" if won else "search_failed"}
            if C.CLASSES.get(tool) == "download":
                s["phase"] = {"awaiting_confirmation": "awaiting_confirmation", "succeeded": "completed"}.get(status, "download_failed")
            if C.CLASSES.get(tool) == "login":
                s |= {"domain": "institutional_access", "source": "cnki", "phase": "completed" if won else "authentication_required"}
            call = e.get("call_id", "")
            if status == "awaiting_confirmation":
                s["pending"] = (call, tool, e["arguments"]["query"])
            elif status in ("succeeded", "failed", "cancelled") or s["pending"] and s["pending"][0] == call:
                s["pending"] = None
            if won:
                named = [x["paper_id"] for x in e["result"]["items"][:20] if isinstance(x, dict) and "paper_id" in x] + (["single"] if "paper" in e["result"] else [])
                named = list(dict.fromkeys(reversed(named)))[::-1]  # the last mention counts
                papers = ([p for p in papers if p not in named] + named)[-30:]
                s |= {"last_tool": tool, "error": ""}
            if status == "failed":
                s["error"] = e.get("error") or "inner"
        out.append(dict(s))
    return out, papers


def seen(r):
    pending = r["pending"] if not isinstance(r["pending"], str) else json.loads(r["pending"])
    route = json.loads(r["route"])["confidence"] if r["route"] else None
    return {k: r[k] for k in C.START if k not in ("route", "results")} | {"route": route, "pending": (pending["call_id"], pending["tool_name"], pending["arguments"]["query"]) if pending else None}


def wanted(s):
    return {k: v for k, v in s.items() if k != "results"}


@pytest.fixture(scope="module")
def logs():
    rng = random.Random(8)
    return {c: list(some_events(rng, n)) for c, n in (("one", 150), ("two", 20), ("three", 1))}


SCHEMA = "conversation_id string, at long, event string"


def test_states_after_each_event(spark, logs):
    rows = [(c, i, json.dumps(e)) for c, es in logs.items() for i, e in enumerate(es)]
    d = spark.createDataFrame(rows + [(None, 5, "no json"), (None, 2**60 + 1, None)], SCHEMA).repartition(6)
    got = {(r["conversation_id"], r["at"]): r.asDict(recursive=True) for r in C.conversation_states(d, ["conversation_id"], ["at"]).collect()}
    assert len(got) == len(rows) + 2 and got[None, 2**60 + 1]["state_version"] == 2 and got[None, 5]["phase"] == "idle"
    for c, es in logs.items():
        for i, s in enumerate(plain(es)[0]):
            assert (seen(got[c, i]), got[c, i]["state_version"]) == (wanted(s), i + 1)
    papers = C.found_papers(d, ["conversation_id"], ["at"]).orderBy("place").collect()
    assert {c: [p.paper_id for p in papers if p.conversation_id == c] for c in logs} == {c: plain(es)[1] for c, es in logs.items()}


def test_a_stream_of_conversations_goes_on_after_a_restart(keyed, logs, tmp_path):
    src = f"file://{tmp_path}/in"
    for part in (slice(0, 40), slice(40, 41), slice(41, None)):
        rows = [(c, i, json.dumps(e)) for c, es in logs.items() for i, e in list(enumerate(es))[part]]
        keyed.createDataFrame(rows, SCHEMA).write.mode("append").json(src)
        got = run(C.conversation_stream(keyed.readStream.schema(SCHEMA).json(src)), tmp_path)
        upto = {c: list(es)[: part.stop] for c, es in logs.items()}
        assert {r["conversation_id"] for r in got} == {c for c, _, _ in rows}
        for r in got:
            states, papers = plain(upto[r["conversation_id"]])
            assert (seen(r), r["papers"], r["state_version"]) == (wanted(states[-1]), papers, len(states))


def test_sessions_expire_by_a_timer(keyed, tmp_path):
    start, src, schema = datetime(2026, 1, 1), f"file://{tmp_path}/in", "session_id string, event_id long, action string, at timestamp"
    hour = lambda h: start + timedelta(hours=h)

    def add(*rows):
        keyed.createDataFrame([(s, i, a, hour(h)) for s, i, a, h in rows], schema).write.mode("append").json(src)
        return [(r["session_id"], r["status"]) for r in run(expiry.session_stream(keyed.readStream.schema(schema).json(src)), tmp_path)]

    assert sorted(add(("a", 1, "started", 0), ("a", 2, "verified", 1), ("b", 3, "verified", 2), ("b", 4, "revoked", 3), ("c", 5, "verified", 3))) == [("a", "active"), ("b", "revoked"), ("c", "active")]
    assert sorted(add(("c", 6, "activated", 8), ("b", 7, "verified", 9))) == [("a", "expired"), ("b", "revoked"), ("c", "active")]
    assert add(("d", 8, "verifying", 12)) == [("d", "verifying")]  # c was activated again
    assert sorted(add(("d", 9, "error", 17))) == [("c", "expired"), ("d", "error")]


def test_a_stream_of_calls_hits_as_the_table_does(keyed, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice("stu"), i, rng.choice("abcdef"), i + rng.random() / 2) for i in range(600)]
    schema, src, got = "s string, event_id long, call string, at double", f"file://{tmp_path}/in", {}
    for part in (rows[:250], rows[250:251], rows[251:]):
        keyed.createDataFrame(part, schema).write.mode("append").json(src)
        q = expiry.response_stream(keyed.readStream.schema(schema).json(src), "s", 25.0, 3)
        q = q.writeStream.outputMode("append").foreachBatch(lambda b, n: got.update({r.event_id: r.cached for r in b.collect()})).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    want, held = {}, {}
    for s, i, call, at in rows:
        own = held.setdefault(s, OrderedDict())
        want[i] = call in own and at - own[call] <= 25
        if not want[i]:
            own[call] = at
        own.move_to_end(call)
        while len(own) > 3:
            own.popitem(last=False)
    assert got == want and len({*want.values()}) == 2
    d = keyed.createDataFrame(rows, schema)
    assert {r.event_id: r.cached for r in cached_calls(d, ["s"], ["at"], "call", "at", 25.0, 3).collect()} == want


def test_folds_leave_other_columns_alone(spark):
    big = 9007199254740993
    d = spark.createDataFrame([(None, 1, big), ("a", 2, None), (None, 3, None), ("a", 4, big), (None, 5, 7)], "k string, i long, v long").repartition(3)
    step = lambda n, i: (n + 1, (n + 1, None if n else "x"))
    out = {r.i: (r.v, r.n, r.t) for r in folded(d, ["k"], ["i"], ["i"], lambda: 0, step, "n long, t string").collect()}
    assert out == {1: (big, 1, "x"), 3: (None, 2, None), 5: (7, 3, None), 2: (None, 1, "x"), 4: (big, 2, None)}
    d = spark.createDataFrame([("a", 0.0, big), ("a", 1.0, None), (None, 2.0, 5), ("a", None, 6)], "k string, t double, v long")
    assert sorted((r.v, r.allowed) for r in rate_limited(d.where("v is not null"), "k", F.col("t"), ["v"], limit=1).collect()) == [(5, False), (6, False), (big, True)]
    assert [(r.v, r.allowed) for r in rate_limited(d.where("v is null"), "k", F.col("t"), ["v"]).collect()] == [(None, True)]


def jobs(spark, *ids, at=0):
    return spark.createDataFrame([(i, "t", "u", f"task-{i}", 0, datetime(2026, 1, 1) + timedelta(minutes=at)) for i in ids], queue.JOB)


def test_a_job_between_reserve_and_acknowledgement_is_delivered_again(keyed, tmp_path):
    queue.register(keyed)
    path, seen = f"{tmp_path}/queue", []
    names = lambda part: queue.Folder(path).names(part)
    queue.enqueue(jobs(keyed, "a", "b").repartition(2), path)
    assert len(names("jobs")) == 2 and names("aside") == []

    def work(die):
        def batch(b, n):
            seen.extend((r.job_id, r.attempt, n) for r in b.collect())
            if die:
                raise RuntimeError("killed")

        q = queue.delivered(keyed, path).writeStream.foreachBatch(batch).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception as e:  # noqa: BLE001
            assert die and "killed" in str(e)

    work(die=True)
    assert sorted(seen) == [("a", 0, 0), ("b", 0, 0)] and len(names("jobs")) == 2 and len(names("reserved")) == 1
    queue.enqueue(jobs(keyed, "c"), path)
    work(die=False)  # the batch that was killed, and then what came since
    work(die=False)
    assert sorted(seen[2:4]) == [("a", 0, 0), ("b", 0, 0)] and [(j, a) for j, a, _ in seen[4:]] == [("c", 0)]
    queue.enqueue(jobs(keyed, "c", "d", at=1), path)  # c a second time
    work(die=False)
    assert [(j, a) for j, a, _ in seen[5:]] == [("d", 0)]
    dead = queue.retried(jobs(keyed, "x").withColumn("attempt", F.lit(2)), path, F.current_timestamp())
    assert [r.job_id for r in dead.collect()] == ["x"] and queue.retried(jobs(keyed, "e"), path, F.lit("2026-01-01 00:02:00").cast("timestamp")).count() == 0
    work(die=False)
    assert [(j, a) for j, a, _ in seen[6:]] == [("e", 1)]
    work(die=False)
    assert len(seen) == 7 and len(names("done")) + len(names("jobs")) == 6


def test_frames_are_written_once(keyed, tmp_path):
    queue.register(keyed)
    src, out = f"file://{tmp_path}/in", f"{tmp_path}/out"
    frames = lambda: sorted(t for _, t in queue.frames_since(out))

    def go():
        d = keyed.readStream.schema("event string, data string").json(src).coalesce(1)
        d.writeStream.format("event_frames").option("path", out).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    keyed.createDataFrame([("progress", "1")], "event string, data string").write.json(src)
    go()
    assert frames() == ["event: progress\ndata: 1\n\n"]
    (tmp_path / "checkpoint" / "commits" / "0").unlink()  # as if the driver had died before it noted the batch
    (tmp_path / "checkpoint" / "commits" / ".0.crc").unlink(missing_ok=True)
    go()
    assert frames() == ["event: progress\ndata: 1\n\n"] and len(queue.Folder(out).names("frames")) == 1
    keyed.createDataFrame([("completed", "2")], "event string, data string").write.mode("append").json(src)
    go()
    assert frames() == ["event: completed\ndata: 2\n\n", "event: progress\ndata: 1\n\n"] and [b for b, _ in queue.frames_since(out, 0)] == [1]


def test_a_tail_replays_goes_on_and_stops(keyed, tmp_path):
    src, schema, got = f"file://{tmp_path}/in", "task_id string, event_id long, event string, data string", []

    def add(*rows):
        keyed.createDataFrame([(t, i, e, f"d{i}") for t, i, e in rows], schema).write.mode("append").json(src)
        q = queue.tailed(keyed.readStream.schema(schema).json(src), after=1)
        q = q.writeStream.outputMode("append").foreachBatch(lambda b, n: got.extend((r.task_id, r.place, r.event) for r in b.orderBy("task_id", "place").collect())).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()

    add(("a", 1, "queued"), ("a", 3, "progress"), ("a", 2, "progress"), ("b", 4, "queued"))
    assert got == [("a", 1, "progress"), ("a", 2, "progress")]
    add(("a", 5, "completed"), ("a", 6, "late"), ("b", 7, "progress"))
    assert got[2:] == [("a", 3, "completed"), ("b", 1, "progress")]
    add(("a", 8, "progress"), ("b", 9, "failed"))
    assert got[4:] == [("b", 2, "failed")]


def test_a_scoped_read_opens_one_folder(spark, tmp_path):
    from lectern.operators.scope import scoped
    from lectern.scratch import read_version, write_version

    path = f"file://{tmp_path}/papers"
    d = spark.createDataFrame([("007", "u", 1), ("007", "v", 2), ("7", "u", 3)], "tenant_id string, user_id string, paper int")
    assert write_version(d, path, ("tenant_id", "user_id")) == 1
    own = scoped(read_version(spark, path), "007", "u")
    assert [tuple(r) for r in own.select("tenant_id", "user_id", "paper").collect()] == [("007", "u", 1)]
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "tenant_id" in plan.split("PartitionFilters: [")[1].split("]")[0] and "user_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    active = spark.createDataFrame([("007", "active"), ("7", "closed")], "tenant_id string, status string")
    active.write.parquet(f"{tmp_path}/tenants")
    joined = read_version(spark, path).join(spark.read.parquet(f"{tmp_path}/tenants").where("status = 'active'"), "tenant_id")
    assert sorted(r.paper for r in joined.collect()) == [1, 2] and "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString()


def test_sketches_of_latency_merge(spark):
    from lectern.streaming import state

    rng = random.Random(4)
    rows = [("ab"[i % 2], i % 4 == 0, 10, i % 3 == 0, i % 5 > 0, rng.expovariate(0.01)) for i in range(20000)]
    calls = spark.createDataFrame(rows, "g string, baseline boolean, input_tokens long, cached boolean, cacheable boolean, latency_ms double")
    none = spark.createDataFrame([("c", None)], "g string, deterministic boolean")
    d = state.usage_rates(calls, ["g"], none, none.withColumnRenamed("deterministic", "approved"))
    out = {r.g: r for r in d.collect()}
    assert out["c"].calls == 0 and out["c"].no_call_rate == 0.0 and out["c"].token_saving is None and out["a"].token_saving == 0.0 and out["b"].token_saving is None and out["a"].approval_rate is None
    every = sorted(r[5] for r in rows)
    p95 = state.merged_latency(d.withColumn("all", F.lit(1)), ["all"]).first().latency_p95
    assert abs(sum(x <= p95 for x in every) / len(every) - 0.95) < 0.014
