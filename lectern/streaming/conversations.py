"""Conversations as they stand after each event: assignments by a table of transitions, carried forward along the log.

What an event sets follows from its kind, the class of its tool and the outcome, and is looked up in ``TRANSITIONS``; values
come from the event by built-in expressions. The state after an event is then the last value that was set of each field, so
no function sees a conversation as a whole: ``carried`` finds it inside ranges of the log and carries it from range to range,
and one conversation is spread over as many tasks as it has ranges. For streams, Spark keeps the fields as value state and the
papers that were found as map state, keyed by conversation (``conversation_stream``); both use the same assignments.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.operators.collections import recent_distinct
from lectern.scratch import stored

# Classes of tools, the phases and domains that they lead to, outcomes that end a call, what is kept.
CLASSES = {
    "search_cnki_papers": "search", "search_papers": "search", "download_cnki_selections": "download", "download_institution_url": "download", "acquire_paper_to_knowledge": "download",
    "start_institution_login": "login", "confirm_institution_browser_login": "login",
}
OUTCOMES = ("awaiting", "won", "failed", "cancelled", "other")
PHASES = {
    "search": {"won": "selection_ready", "": "search_failed"}, "download": {"awaiting": "awaiting_confirmation", "won": "completed", "": "download_failed"},
    "login": {"won": "completed", "": "authentication_required"}, "": {"": None},
}
DOMAINS = {"search": "literature", "login": "institutional_access"}
SECRET = ("tenant_id", "user_id", "confirmation_token")
RESULTS, ARTIFACTS = 20, 30

#: (kind, class, outcome, phase, domain); a null leaves the field as it is.
TRANSITIONS = [("user", "", "", "planning", None), ("route", "", "", None, None), ("clear", "", "", "idle", None)]
TRANSITIONS += [("tool", c, o, by.get(o, by[""]), DOMAINS.get(c)) for c, by in PHASES.items() for o in OUTCOMES]

EVENT = "kind string, content string, tool_name string, status string, call_id string, error string, arguments string, result string, intent string, target string, execution_mode string, reasons string, confidence double, planned_steps string"
REF = "paper_id string, title string, source string, year string, doi string"
START = {"goal": "", "domain": "general", "source": "", "phase": "idle", "route": None, "last_tool": "", "query": "", "error": "", "results": "[]"}
PENDING = "call_id string, tool_name string, arguments map<string,string>"


def _mapped(values: dict, key: Column, default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(default))


def assigned(events: DataFrame, event: str = "event") -> DataFrame:
    """``events`` with what each of them, a JSON text, sets: the fields of ``START``, ``papers``, ``pending``, ``ends`` (whether
    any pending call ends) and ``call_id``. Null: nothing is set. For tables and streams; what is no event sets nothing."""
    spark = events.sparkSession
    names = events.columns
    d = events.withColumn("e", F.coalesce(F.from_json(event, EVENT), F.from_json(F.lit("{}"), EVENT)))
    e = lambda c: F.col(f"e.{c}")
    tool = e("kind") == "tool"
    outcome = F.when(e("status") == "awaiting_confirmation", "awaiting").when(e("status") == "succeeded", "won").when(e("status").isin("failed", "cancelled"), e("status")).otherwise("other")
    d = d.withColumns({"class": F.when(tool, _mapped(CLASSES, F.coalesce(e("tool_name"), F.lit("")), "")).otherwise(""), "outcome": F.when(tool, outcome).otherwise("")})
    table = spark.createDataFrame([(*t,) for t in TRANSITIONS], "k string, c string, o string, phase string, domain string")
    d = d.join(F.broadcast(table), (e("kind") == F.col("k")) & (F.col("class") == F.col("c")) & (F.col("outcome") == F.col("o")), "left")  # a table of a few rows
    won, argument = tool & (F.col("outcome") == "won"), lambda k: F.get_json_object(e("arguments"), f"$.{k}")
    search, given = F.col("class") == "search", lambda c: F.nullif(c, F.lit(""))
    items = F.coalesce(F.from_json(F.get_json_object(e("result"), "$.items"), "array<string>"), F.array().cast("array<string>"))
    refs = F.concat(F.transform(F.slice(items, 1, RESULTS), lambda x: F.from_json(x, REF)), F.array(F.from_json(F.get_json_object(e("result"), "$.paper"), REF)))
    refs = F.filter(refs, lambda r: r.isNotNull() & (F.to_json(r) != "{}"))
    call = F.coalesce(e("call_id"), F.lit(""))
    waits = F.struct(call.alias("call_id"), e("tool_name").alias("tool_name"), F.map_filter(F.coalesce(F.from_json(e("arguments"), "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*SECRET)).alias("arguments"))
    route = F.struct(e("intent").alias("intent"), e("target").alias("target"), e("execution_mode").alias("execution_mode"), e("reasons").alias("reasons"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(e("confidence"), F.lit(0.0)))), 3).alias("confidence"), e("planned_steps").alias("planned_steps"))
    return d.select(
        *names, F.when(e("kind") == "user", F.left(F.trim(F.coalesce(e("content"), F.lit(""))), F.lit(1000))).alias("goal"), "domain",
        F.when(search, F.when(e("tool_name") == "search_cnki_papers", "cnki").otherwise(F.coalesce(given(argument("source")), F.lit("all")))).when(F.col("class") == "login", "cnki").alias("source"), "phase",
        F.when(e("kind") == "route", F.to_json(route)).alias("route"), F.when(won, e("tool_name")).alias("last_tool"), F.when(search, F.left(F.coalesce(argument("query"), F.lit("")), F.lit(500))).alias("query"),
        F.when((e("kind") == "user") | won, "").when(F.col("outcome") == "failed", F.left(F.coalesce(given(e("error")), F.get_json_object(e("result"), "$.error"), F.lit("")), F.lit(1000))).alias("error"),
        F.when(won, F.to_json(refs)).alias("results"), F.when(won, refs).alias("papers"), F.when(F.col("outcome") == "awaiting", waits).alias("pending"),
        ((e("kind") == "clear") | F.col("outcome").isin("won", "failed", "cancelled")).alias("ends"), F.when(tool & (F.col("outcome") == "other"), call).alias("call_id"),
    )


def carried(df: DataFrame, key: list[str], order: list[str], fields: list[str], count: str | None = None) -> DataFrame:
    """``df`` with each of ``fields`` as its last value, not null, up to the row, and ``count``: the row's place in its key, from 1.

    Rows are cut into ranges of (key, order); a range finds its own last values, and gets those before from one row for each
    range and key. Rows equal in key and order come in any order; null keys are one key.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = stored(df.repartitionByRange(n, *key, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    at = F.struct(*order)
    ends = d.groupBy(*key, "__range").agg(F.count(F.lit(1)).alias("__n"), *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in fields])
    before = Window.partitionBy(*key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*key, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"), *[F.last(c, True).over(before).alias(c) for c in fields])
    here = Window.partitionBy(*key, "__range").orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({c: F.last(c, True).over(upto) for c in fields} | {"__i": F.row_number().over(here)})
    on = F.lit(True)
    for c in (*key, "__range"):
        on = on & F.col(f"d.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
    d = d.alias("d").join(ends.alias("b"), on)
    out = [F.coalesce(F.col(f"d.{c}"), F.col(f"b.{c}")).alias(c) if c in fields else F.col(f"d.`{c}`") for c in df.columns]
    return d.select(*out, *([(F.col("b.__n") + F.col("d.__i")).cast("long").alias(count)] if count else []))


def conversation_states(events: DataFrame, key: list[str], order: list[str], event: str = "event", fields: list[str] | None = None) -> DataFrame:
    """``events`` with the fields of ``START``, ``pending`` (a call that waits for the user) and ``state_version`` after each; of the
    fields only those named, where they are.

    A pending call ends when any call does, when it is reported again, or when it is cleared. Column names of ``events`` aren't
    those of the state.
    """
    wanted = [*START, "pending"] if fields is None else fields
    kept = [c for c in wanted if c != "pending"]
    out = [*events.columns, *[F.coalesce(F.col(c), F.lit(START[c])).alias(c) for c in kept]]
    d = assigned(events, event)
    if "pending" not in wanted:
        return carried(d.select(*events.columns, *kept), key, order, kept, "state_version").select(*out, "state_version")
    at = F.struct(*order)
    d = d.withColumn("set_at", F.when(F.col("pending").isNotNull(), at)).select(*events.columns, *kept, "pending", "set_at", "ends", "call_id")
    d = carried(d, key, order, [*kept, "pending", "set_at"], "state_version")
    ended = F.col("ends") | (F.col("call_id") == F.col("pending.call_id"))
    d = carried(d.withColumn("ended_at", F.when(ended, at)), key, order, ["ended_at"])
    waits = F.col("pending").isNotNull() & (F.col("ended_at").isNull() | (F.col("set_at") > F.col("ended_at")))
    return d.select(*out, F.when(waits, F.col("pending")).alias("pending"), "state_version")


def found_papers(events: DataFrame, key: list[str], order: list[str], event: str = "event") -> DataFrame:
    """(*key, paper_id, title, source, year, doi): the papers that successful calls of a conversation named, the 30 named last.

    ``place`` orders them; a paper that is named again moves to the end.
    """
    d = assigned(events, event).select(*key, F.struct(*order).alias("at"), F.posexplode("papers").alias("i", "p"))
    d = d.where("p.paper_id IS NOT NULL AND p.paper_id <> ''").select(*key, "p.*", F.struct("at", "i").alias("place"))
    return recent_distinct(d, key, "paper_id", "place", ARTIFACTS)


class ConversationState(StatefulProcessor):
    """Value state: the fields; map state: papers by id, each with the number of its last mention. Rows of a batch in order of ``at``."""

    FIELDS = "version long, mention long, " + ", ".join(f"{c} string" for c in START) + ", pending string, pending_call string"

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fields = handle.getValueState("fields", self.FIELDS)
        self.papers = handle.getMapState("papers", "paper_id string", "mention long, paper string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.fields.get() if self.fields.exists() else None
        names = ["version", "mention", *START, "pending", "pending_call"]
        s = dict(zip(names, held)) if held else {"version": 0, "mention": 0, **START, "pending": None, "pending_call": None}
        for row in pd.concat(list(rows)).sort_values("at", kind="stable").to_dict("records"):
            s["version"] += 1
            s |= {c: row[c] for c in START if isinstance(row[c], str)}
            if isinstance(row["pending"], str):
                s |= {"pending": row["pending"], "pending_call": row["pending_call"]}
            elif row["ends"] is True or isinstance(row["call_id"], str) and row["call_id"] == s["pending_call"]:
                s |= {"pending": None, "pending_call": None}
            for paper in row["papers"] if row["papers"] is not None else []:
                if paper["paper_id"]:
                    s["mention"] += 1
                    self.papers.updateValue((paper["paper_id"],), (s["mention"], paper["text"]))
        kept = sorted((v[0], k[0]) for k, v in self.papers.iterator()) if s["mention"] else []
        for _, name in kept[:-ARTIFACTS]:
            self.papers.removeKey((name,))
        self.fields.update(tuple(s[c] for c in names))
        yield pd.DataFrame({self.key: [key[0]], **{c: [s[c]] for c in START}, "pending": [s["pending"]], "papers": [[name for _, name in kept[-ARTIFACTS:]]], "state_version": [s["version"]]})

    def close(self) -> None:
        pass


def conversation_stream(events: DataFrame, key: str = "conversation_id", event: str = "event") -> DataFrame:
    """The state of each conversation of a stream after each of its batches: (key, fields, pending as JSON, papers, state_version).

    Rows are ordered by ``at`` inside a batch, whose size a trigger bounds. Needs the RocksDB state store.
    """
    d = assigned(events.select(key, "at", event), event)
    d = d.withColumns({"pending_call": F.col("pending.call_id"), "pending": F.to_json("pending"), "papers": F.transform("papers", lambda p: F.struct(p["paper_id"].alias("paper_id"), F.to_json(p).alias("text"))), "ends": F.coalesce("ends", F.lit(False))}).drop(event)
    out = f"`{key}` {dict(events.dtypes)[key]}, " + ", ".join(f"{c} string" for c in START) + ", pending string, papers array<string>, state_version long"
    return d.groupBy(key).transformWithStateInPandas(ConversationState(key), out, "Update", "None")
