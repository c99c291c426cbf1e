"""State that follows from the rows before: folds over ordered logs, caches, queues, sessions, usage.

Where a row's answer depends on earlier answers, no window frame can say it. ``folded`` deals rows by key, sorts them
inside tasks, and passes them through in Arrow batches; a task holds one key's state and one batch, never a whole key.
A key's rows go through one task, as its order asks; other states here are aggregates or expressions.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def folded(log: DataFrame, key: list[str], order: list[str], inputs: list[str], start: Callable[[], object], step: Callable, out: str) -> DataFrame:
    """``log`` with the columns ``out`` (a schema): ``step(state, *inputs)`` gives the next state and a row of ``out``.

    The columns of ``log`` go through as they are; a null key is a key like any other.
    """
    names, added = log.columns, StructType.fromDDL(out)
    kinds = to_arrow_schema(added)
    d = log.repartition(*key).sortWithinPartitions(*key, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for b in batches:
            rows = []
            for k, *x in zip(zip(*(b[c].to_pylist() for c in key)), *(b[c].to_pylist() for c in inputs)):
                if k != current:
                    current, state = k, start()
                state, row = step(state, *x)
                rows.append(row)
            yield pa.record_batch({**{c: b[c] for c in names}, **{f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)}})

    return d.mapInArrow(run, StructType([*log.schema, *added]))


def calls(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """Each tool call as it stands: its newest row."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")


def cached_calls(log: DataFrame, scope: list[str], order: list[str], call_key: str, at: str, ttl: float, entries: int) -> DataFrame:
    """Adds ``cached``: whether the same call of its scope was answered at most ``ttl`` seconds before and is still held.

    A cache holds ``entries`` answers of a scope; the one that is longest unused goes first. A miss stores its answer.
    """
    def step(held: OrderedDict, k, t):
        hit = k in held and t - held[k] <= ttl and ttl > 0
        if not hit:
            held[k] = t
        held.move_to_end(k)
        while len(held) > entries:
            held.popitem(last=False)
        return held, (hit,)

    return folded(log, scope, order, [call_key, at], OrderedDict, step, "cached boolean")


def call_signature(*parts: Column) -> Column:
    """A hash of everything that makes two calls the same, the tenant among it."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256)


# --- logs, tasks, sessions, queues -----------------------------------------------------------------------------------

TERMINAL = ("completed", "failed")


def replayed(log: DataFrame, task: str = "task_id", order: str = "event_id", event: str = "event", after: int = -1) -> DataFrame:
    """Events of each task after an offset, up to the first that ends it."""
    end = log.where(F.col(event).isin(*TERMINAL)).groupBy(task).agg(F.min(order).alias("__end"))
    return log.where(F.col(order) > after).join(end, task, "left").where(F.col("__end").isNull() | (F.col(order) <= F.col("__end"))).drop("__end")


def frames(event: Column, data: Column) -> Column:
    """Events as server-sent frames."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def task_status(log: DataFrame, task: str = "task_id", order: str = "event_id") -> DataFrame:
    """(task, status, phase, percent) by each task's last event (event, phase, percent, needs_confirmation)."""
    own = F.struct(
        F.when(F.col("event") == "completed", "completed").when(F.col("event") == "failed", "failed").when(F.col("event") == "queued", "queued")
        .when((F.col("event") == "outline_required") & F.coalesce("needs_confirmation", F.lit(False)), "waiting_user").otherwise("running").alias("status"),
        F.when(F.col("event").isin(*TERMINAL), F.col("event")).otherwise(F.col("phase")).alias("phase"), F.when(F.col("event") == "completed", 100).otherwise(F.col("percent")).alias("percent"),
    )
    return log.groupBy(task).agg(F.max_by(own, order).alias("r")).select(task, "r.*")


def can_delete(status: Column) -> Column:
    return status.isin(*TERMINAL)


def observation(event_type: Column) -> Column:
    """(kind, level) under which an event is traced."""
    # Kinds of event types.
    kinds = {"model_call": "generation", "tool_call": "tool", "retrieval": "retriever", "workflow": "chain", "agent": "agent", "evaluation": "evaluator"}
    out = F.lit("span")
    for k, v in kinds.items():
        out = F.when(event_type == k, v).otherwise(out)
    return F.struct(out.alias("kind"), F.when(event_type.isin("error", "failed"), "ERROR").otherwise("DEFAULT").alias("level"))


def session_status(log: DataFrame, now: Column, session: str = "session_id", order: str = "event_id") -> DataFrame:
    """(session, status, verified_at, expires_at): each access session after its log (action, at).

    started: awaiting_user_login; verifying; verified or activated: active for eight hours; login_required: awaiting
    again; error; revoked, which nothing undoes. An active session whose time has come is expired.
    """
    to = F.create_map(*[F.lit(x) for kv in {
        "started": "awaiting_user_login", "verifying": "verifying", "verified": "active", "activated": "active", "login_required": "awaiting_user_login", "error": "error", "revoked": "revoked",
    }.items() for x in kv])
    revoked = F.max(F.when(F.col("action") == "revoked", F.lit(True)))
    d = log.groupBy(session).agg(
        F.max_by(F.struct("action", "at"), order).alias("l"), F.max_by("at", F.when(F.col("action").isin("verified", "activated"), F.col(order))).alias("verified_at"), revoked.alias("gone"),
    )
    status = F.when(F.col("gone"), "revoked").otherwise(F.coalesce(F.try_element_at(to, F.col("l.action")), F.lit("disconnected")))
    expires = F.col("verified_at") + F.expr("INTERVAL 8 HOURS")
    return d.select(session, F.when((status == "active") & (expires <= now), "expired").otherwise(status).alias("status"), "verified_at", expires.alias("expires_at"))


def idle_sessions(log: DataFrame, key: str, at: str, gap_seconds: int = 3600) -> DataFrame:
    """(key, opened, last_used, n): runs of use that end once nothing has come for the gap, 300 seconds at least."""
    gap = f"{max(300, gap_seconds)} seconds"
    d = log.withColumn("__at", F.col(at).cast("timestamp"))
    if log.isStreaming:
        d = d.withWatermark("__at", gap)
    d = d.groupBy(key, F.session_window("__at", gap).alias("w")).agg(F.max("__at").alias("last_used"), F.count(F.lit(1)).alias("n"))
    return d.select(key, F.col("w.start").alias("opened"), "last_used", "n")


def queue_state(log: DataFrame, job: str = "job_id", order: str = "event_id", attempts: int = 3) -> DataFrame:
    """(job, status, attempt) of an at-least-once queue after its log (action: enqueue, reserve, ack, fail, recover).

    A failed job waits again until it has been tried ``attempts`` times, then it is dead. Jobs that are reserved and
    neither acknowledged nor failed are what a restart must recover. Delivered twice, an acknowledgement changes nothing.
    """
    d = log.groupBy(job).agg(F.max_by("action", order).alias("last"), F.count_if(F.col("action") == "reserve").alias("attempt"), F.max((F.col("action") == "ack").cast("int")).alias("acked"))
    status = (
        F.when(F.col("acked") == 1, "done").when((F.col("last") == "fail") & (F.col("attempt") >= attempts), "dead").when(F.col("last") == "reserve", "unacknowledged").otherwise("waiting")
    )
    return d.select(job, status.alias("status"), "attempt")


def recovered(log: DataFrame, job: str = "job_id", order: str = "event_id") -> DataFrame:
    """The jobs that go back to the queue when workers start."""
    return queue_state(log, job, order).where("status = 'unacknowledged'").select(job)


def pattern_counts(events: DataFrame, signature: list[str], success: Column) -> DataFrame:
    """Successes and failures by signature, for a table or (in update mode) a stream."""
    return events.groupBy(*signature).agg(F.count_if(success).alias("successes"), F.count_if(~success).alias("failures"))


def usage(log: DataFrame, group: list[str], metadata: str = "metadata") -> DataFrame:
    """Model calls by group from their JSON metadata: tokens, share answered from the cache, and the 95th percentile of latency."""
    m = F.from_json(metadata, "input_tokens long, output_tokens long, cached boolean, latency_ms double")
    return log.withColumn("__m", m).groupBy(*group).agg(
        F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("__m.input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("__m.output_tokens"), F.lit(0)).alias("output_tokens"),
        F.round(F.avg(F.coalesce("__m.cached", F.lit(False)).cast("double")), 4).alias("cache_rate"), F.percentile("__m.latency_ms", 0.95).alias("latency_p95"),
    )


def usage_rates(calls: DataFrame, group: list[str], plans: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each group: token saving, share of plans made without a call, cache hits, share of candidates approved, and latency.

    ``calls`` (*group, baseline, input_tokens, cached, cacheable, latency_ms): saving is one less the input tokens over those of
    the baseline's calls; hits are of the calls that a cache may answer. ``plans`` (*group, deterministic), ``candidates``
    (*group, approved). A rate without anything to divide by is null. ``latency`` is a KLL sketch as bytes, which merges by
    ``kll_merge_agg_double``; ``latency_p95`` is read from it, and its rank is within 1.4 % of 95 % (99 % of the time).
    """
    rate = lambda a, b: F.when(b > 0, F.round(a / b, 4))
    held = F.coalesce("cached", F.lit(False))
    c = calls.groupBy(*group).agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.when(F.col("baseline"), F.col("input_tokens"))).alias("__before"), F.sum(F.when(~F.col("baseline"), F.col("input_tokens"))).alias("__after"),
        rate(F.count_if(held & F.col("cacheable")), F.count_if("cacheable")).alias("cache_hit_rate"), F.kll_sketch_agg_double(F.col("latency_ms").cast("double")).alias("latency"),
    )
    c = c.withColumn("token_saving", rate(F.col("__before") - F.coalesce("__after", F.lit(0)), F.col("__before"))).drop("__before", "__after")
    share = lambda d, flag, out: d.groupBy(*group).agg(rate(F.count_if(F.coalesce(flag, F.lit(False))), F.count(F.lit(1))).alias(out))
    d = c.join(share(plans, "deterministic", "no_call_rate"), group, "full_outer").join(share(candidates, "approved", "approval_rate"), group, "full_outer")
    p95 = F.when(F.kll_sketch_get_n_double("latency") > 0, F.kll_sketch_get_quantile_double("latency", F.lit(0.95)))
    return d.select(*group, F.coalesce("calls", F.lit(0)).alias("calls"), "token_saving", "no_call_rate", "cache_hit_rate", "approval_rate", p95.alias("latency_p95"), "latency")


def merged_latency(rates: DataFrame, group: list[str]) -> DataFrame:
    """(*group, latency_p95) over the sketches of several rows, no call being read again."""
    d = rates.where("latency IS NOT NULL").groupBy(*group).agg(F.kll_merge_agg_double("latency").alias("latency"))
    return d.select(*group, F.when(F.kll_sketch_get_n_double("latency") > 0, F.kll_sketch_get_quantile_double("latency", F.lit(0.95))).alias("latency_p95"))
