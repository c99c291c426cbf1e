"""Plans as graphs of tasks: which tasks a goal asks for, in which waves they run, what they wait for."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.scratch import stored

# The tasks of a writing goal, the words that ask for citation rules, and the sizes that ask for a critic.
TASKS = (
    ("research_scope", "literature_retrieval", "research_subagent", "Define retrieval scope, query variants, evidence priority and exclusions.", False),
    ("argument_structure", "outline", "structure_subagent", "Define section boundaries, argument order and human review points.", False),
    ("citation_policy", "citation_audit", "citation_subagent", "Define citation coverage targets and evidence-risk checks.", False),
    ("preflight_critic", "quality_review", "critic_subagent", "Review the plan for missing constraints, contradictions and unverifiable claims.", True),
)
CITATION_WORDS, LONG_GOAL, MANY_PAPERS = "citation|reference|paper|survey", 180, 30


def planned(goals: DataFrame, key: str) -> DataFrame:
    """(key, position, node_id, capability, agent_name, instruction, optional, depends_on) for ``goals`` (key, goal,
    citation_style, max_papers). A blank goal has no tasks; the critic waits for all others."""
    goal = F.coalesce("goal", F.lit(""))
    cite = (F.coalesce("citation_style", F.lit("")) != "") | F.lower(goal).rlike(CITATION_WORDS)
    critic = (F.char_length(goal) >= LONG_GOAL) | (F.coalesce("max_papers", F.lit(0)) >= MANY_PAPERS)
    first = F.array(F.lit("research_scope"))
    before = F.filter(F.array(F.lit("research_scope"), F.lit("argument_structure"), F.when(cite, "citation_policy")), lambda x: x.isNotNull())
    rules = {"research_scope": (F.lit(True), F.array().cast("array<string>")), "argument_structure": (F.lit(True), first), "citation_policy": (cite, first), "preflight_critic": (critic, before)}
    node = lambda n, c, a, i, o: F.struct(F.lit(n).alias("node_id"), F.lit(c).alias("capability"), F.lit(a).alias("agent_name"), F.lit(i).alias("instruction"), F.lit(o).alias("optional"), rules[n][1].alias("depends_on"))
    every = F.filter(F.array(*[F.when(rules[t[0]][0], node(*t)) for t in TASKS]), lambda x: x.isNotNull())
    return goals.where(F.trim(goal) != "").select(key, F.posexplode(every).alias("position", "n")).select(key, "position", "n.*")


def waves(nodes: DataFrame, node: str = "node_id", depends_on: str = "depends_on") -> DataFrame:
    """Adds ``wave``, from 0: the first in which all a node waits for is done.

    Each round settles one wave by a join, so the rounds are the graph's depth. Cycles and unknown nodes are a ValueError.
    Joins are merges: a broadcast of what is done would pass through the driver in every round.
    """
    nodes = stored(nodes, "nodes")
    edges = stored(nodes.select(node, F.explode(F.array_distinct(depends_on)).alias("__dep")), "edges")
    left, done, wave = nodes, None, 0
    while True:
        open_ = edges if done is None else edges.join(done.select(F.col(node).alias("__dep")).hint("merge"), "__dep", "left_anti")
        ready = stored(left.join(open_.select(node).distinct().hint("merge"), node, "left_anti").withColumn("wave", F.lit(wave)), "wave")
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        if wave % 10 == 9:  # else the plan grows with the waves
            done = stored(done, "waves")
        left = nodes.join(done.select(node).hint("merge"), node, "left_anti")
        wave += 1
    names = [str(r[0]) for r in left.select(node).orderBy(node).limit(20).collect()]
    if names:
        raise ValueError(f"tasks in a cycle or with an unknown dependency: {', '.join(names)}")
    return nodes.withColumn("wave", F.lit(0)) if done is None else done


def inputs_of(nodes: DataFrame, results: DataFrame, node: str = "node_id") -> DataFrame:
    """(node, inputs): the results that each node waits for, by the name of their node; null until all are there."""
    d = nodes.select(node, F.size("depends_on").alias("__n"), F.explode_outer("depends_on").alias("__dep"))
    d = d.join(results.select(F.col(node).alias("__dep"), "result"), "__dep", "left").groupBy(node).agg(F.max("__n").alias("__n"), F.collect_list(F.when(F.col("result").isNotNull(), F.struct("__dep", "result"))).alias("r"))
    return d.select(node, F.when(F.size("r") == F.col("__n"), F.map_from_entries("r")).alias("inputs"))


def run(nodes: DataFrame, runner: Callable[[dict, dict], object], parallel: int = 3, node: str = "node_id") -> list[object]:
    """Results in order of waves; the nodes of a wave, each a Spark job of its own, run ``parallel`` at a time. A plan is a few nodes."""
    rows = sorted((r.asDict() for r in waves(nodes, node).collect()), key=lambda r: (r["wave"], r.get("position", 0), r[node]))
    done: dict[str, object] = {}
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        for wave in sorted({r["wave"] for r in rows}):
            own = [r for r in rows if r["wave"] == wave]
            for r, result in zip(own, pool.map(lambda r: runner(r, {d: done[d] for d in r["depends_on"]}), own)):
                done[r[node]] = result
    return list(done.values())


def progress(phase: Column, percent: Column, message: Column) -> Column:
    return F.struct(F.lit("progress").alias("event"), phase.alias("phase"), message.alias("message"), percent.alias("percent"))
