"""Agents: which call started each, under which other agent it stands, and how deep."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import grammar, times
from tracelake.operators import graph

# Tools that start an agent, and how the receipt of one that goes on by itself begins.
SPAWNERS = ["Agent", "Task", "Workflow"]
RECEIPT = "Async agent launched"
#: Deeper agents, and those of a cycle, have this depth.
DEEPEST = 65


def spawns(calls: DataFrame) -> DataFrame:
    """session_id, spawn_id, tool, trigger, description, agent_type, spawn_name, issuer: each call that starts an agent.

    calls: session_id (of the main transcript), issuer (agent that made the call; null: the session itself), line_no,
    call_id, name, input, ts. A copied transcript repeats calls: the main transcript's comes first, then by issuer, line."""
    given = lambda k: F.get_json_object("input", f"$.{k}")
    rows = calls.filter(F.col("name").isin(SPAWNERS) & F.col("call_id").isNotNull()).select(
        "session_id", F.col("call_id").alias("spawn_id"), F.struct(F.col("issuer").isNotNull().alias("below"), F.coalesce("issuer", F.lit("")).alias("by"), "line_no").alias("place"),
        F.struct(F.col("name").alias("tool"), F.col("ts").alias("trigger"), given("description").alias("description"), given("subagent_type").alias("agent_type"), given("name").alias("spawn_name"), "issuer").alias("s"),
    )
    return rows.groupBy("session_id", "spawn_id").agg(F.min("place").alias("place"), F.min_by("s", "place").alias("s")).select("session_id", "spawn_id", "s.*", "place")


def by_name(agents: DataFrame, spawns: DataFrame) -> DataFrame:
    """agents (session_id, agent_id, name, started) with spawn_id: the latest call for that name that isn't after the
    agent's start; the first recorded one if there is none such, or no start. Of equal times the later recorded.

    One ordered pass over both sides together: nothing is paired, however often a name recurs."""
    named = spawns.filter("spawn_name IS NOT NULL")
    key = ["session_id", "name"]
    calls = named.select("session_id", F.col("spawn_name").alias("name"), F.col("trigger").alias("at"), F.lit(0).alias("side"), "place", "spawn_id", F.lit(None).cast("string").alias("agent_id"))
    ours = agents.filter("name IS NOT NULL").select(*key, F.col("started").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(named.schema["place"].dataType).alias("place"), F.lit(None).cast("string").alias("spawn_id"), "agent_id")
    before = Window.partitionBy(*key).orderBy(F.asc_nulls_first("at"), "side", "place").rowsBetween(Window.unboundedPreceding, 0)
    timed = F.when(F.col("at").isNotNull(), F.col("spawn_id"))
    met = calls.unionByName(ours).withColumn("latest", F.last(timed, ignorenulls=True).over(before)).filter("side = 1")
    first = calls.groupBy(*key).agg(F.min_by("spawn_id", "place").alias("__first"))
    got = met.join(first, key, "left").select("session_id", "agent_id", F.coalesce("latest", "__first").alias("__spawn"))
    return agents.join(got, ["session_id", "agent_id"], "left").withColumn("spawn_id", F.col("__spawn")).drop("__spawn")


def nodes(agents: DataFrame, spawns: DataFrame) -> DataFrame:
    """agents with the spawning call's facts, parent_agent_id and depth (agents above; 0 for the session's own).

    agents: session_id, agent_id, kind (builtin, workflow, teammate), name, team, spawn_id, started, last_activity,
    agent_type, description, meta_parent. Only teammates are looked up by name; their type is the call's rather than the
    agent's own, which holds their name. No agent is its own parent."""
    mates = by_name(agents.filter("kind = 'teammate' AND spawn_id IS NULL"), spawns)
    rest = agents.filter("kind IS DISTINCT FROM 'teammate' OR spawn_id IS NOT NULL")
    calls = spawns.select("session_id", "spawn_id", "tool", "trigger", F.col("description").alias("__said"), F.col("agent_type").alias("__type"), "issuer")
    j = rest.unionByName(mates.select(*rest.columns)).join(calls, ["session_id", "spawn_id"], "left")
    other = lambda c: F.when(F.col(c) != F.col("agent_id"), F.col(c))
    typed = F.when(F.col("kind") == "teammate", F.coalesce("__type", "agent_type")).otherwise(F.coalesce("agent_type", "__type"))
    linked = j.select(
        "session_id", "agent_id", "kind", "name", "team", "spawn_id", "started", "last_activity", typed.alias("agent_type"), F.coalesce("description", "__said").alias("description"), "tool",
        F.coalesce("trigger", "started").alias("trigger"), F.coalesce(other("meta_parent"), other("issuer")).alias("parent_agent_id"),
    )
    name = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("/", "session_id", c))
    above = graph.rooted(linked.select(name("agent_id").alias("child"), name("parent_agent_id").alias("parent")))
    deep = above.select(F.col("node").alias("__node"), F.least("depth", F.lit(DEEPEST)).alias("__depth"))
    depth = F.when(F.col("parent_agent_id").isNull(), 0).otherwise(F.coalesce("__depth", F.lit(DEEPEST)))
    return linked.withColumn("__node", name("agent_id")).join(deep, "__node", "left").withColumn("depth", depth.cast("long")).drop("__node", "__depth")


def subtree(nodes: DataFrame, agent_ids: list[str]) -> DataFrame:
    """agent_id of the agents and all below them."""
    edges = nodes.select(F.col("agent_id").alias("child"), F.col("parent_agent_id").alias("parent")).distinct()
    below = graph.closure(edges, agent_ids).select(F.col("node").alias("agent_id"))
    return below.unionByName(nodes.sparkSession.createDataFrame([(a,) for a in agent_ids], "agent_id string")).distinct()


def admitted(nodes: DataFrame, kinds: list[str] | None = None, types: list[str] | None = None, axis: str = "trigger", since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Nodes of some kinds and types whose time on an axis (trigger, started, last_activity) is in the window. A bound
    leaves out nodes without that time; an empty list asks for nothing."""
    if kinds:
        nodes = nodes.filter(F.col("kind").isin(kinds))
    if types:
        nodes = nodes.filter(F.col("agent_type").isin(types))
    if since is None and until is None:
        return nodes
    return nodes.filter(grammar.window(times.instant(F.col(axis)), since, until))


def returned(nodes: DataFrame, results: DataFrame, tails: DataFrame, journal: DataFrame) -> DataFrame:
    """nodes with `returned` and `source` (result, tail, journal): what an agent handed back.

    A workflow's agent: its entry in the journal, or nothing. Else the result of the spawning call, or, if that is but a
    receipt or missing, the agent's own last message. tails, journal: session_id, agent_id, text (one row an agent)."""
    got = results.groupBy("session_id", F.col("call_id").alias("spawn_id")).agg(F.max_by("content", "line_no").alias("__got"))
    own = ["session_id", "agent_id"]
    j = nodes.join(got, ["session_id", "spawn_id"], "left").join(tails.select(*own, F.col("text").alias("__tail")), own, "left").join(journal.select(*own, F.col("text").alias("__journal")), own, "left")
    source = (
        F.when(F.col("kind") == "workflow", F.when(F.col("__journal").isNotNull(), "journal"))
        .when(F.col("__tail").isNotNull() & (F.col("__got").isNull() | F.col("__got").contains(RECEIPT)), "tail")
        .when(F.col("__got").isNotNull(), "result")
    )
    text = F.when(source == "journal", F.col("__journal")).when(source == "tail", F.col("__tail")).when(source == "result", F.col("__got"))
    return j.withColumn("returned", text).withColumn("source", source).drop("__got", "__tail", "__journal")
