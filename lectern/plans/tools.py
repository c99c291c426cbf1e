"""Operators by name: a registry of tools that make tables, what each needs, and whether a call may run."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tool:
    name: str
    run: Callable[..., DataFrame]
    description: str
    category: str
    safety: str
    needs_user: bool
    parameters: tuple[tuple[str, bool], ...]


TOOLS: dict[str, Tool] = {}


def tool(name: str, description: str, category: str = "general", safety: str = "low", needs_user: bool = True):
    """Registers a function of (spark, …) under a name; its parameters after the first are the tool's."""
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        own = tuple((p.name, p.default is inspect.Parameter.empty) for p in list(inspect.signature(f).parameters.values())[1:])
        TOOLS[name] = Tool(name, f, description, category, safety, needs_user, own)
        return f

    return add


def listing(spark: SparkSession) -> DataFrame:
    """(name, description, category, safety, parameters, required) of all tools."""
    rows = [(t.name, t.description, t.category, t.safety, [p for p, _ in t.parameters], [p for p, r in t.parameters if r]) for t in sorted(TOOLS.values(), key=lambda t: t.name)]
    return spark.createDataFrame(rows, "name string, description string, category string, safety string, parameters array<string>, required array<string>")


def refusal(safety: Column, needs_user: Column, tenant: Column, user: Column, token: Column) -> Column:
    """Why a call may not run; null where it may."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(needs_user & (blank(tenant) | blank(user)), "tenant_id and user_id are required").when((safety == "high") & blank(token), "requires human confirmation")


def judged(calls: DataFrame) -> DataFrame:
    """``calls`` (tool_name, tenant_id, user_id, confirmation_token) with ``refused``: the reason, or null."""
    t = listing_of_safety(calls.sparkSession)
    d = calls.join(F.broadcast(t), "tool_name", "left")  # one row a tool
    why = refusal(F.col("safety"), F.col("needs_user"), F.col("tenant_id"), F.col("user_id"), F.col("confirmation_token"))
    return d.withColumn("refused", F.when(F.col("safety").isNull(), "unknown tool").otherwise(why)).drop("safety", "needs_user")


def listing_of_safety(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t.name, t.safety, t.needs_user) for t in TOOLS.values()], "tool_name string, safety string, needs_user boolean")


def call(spark: SparkSession, name: str, *, confirmation_token: str | None = None, **arguments) -> DataFrame:
    """What a tool gives; PermissionError where it may not run, KeyError for unknown names."""
    t = TOOLS[name]
    if t.needs_user and not (arguments.get("tenant_id") and arguments.get("user_id")):
        raise PermissionError("tenant_id and user_id are required")
    if t.safety == "high" and not confirmation_token:
        raise PermissionError(f"{name} requires human confirmation")
    return t.run(spark, **arguments)
