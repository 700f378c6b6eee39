"""What is open: background tasks, questions, agents' states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sentences by which a shell that was moved to the background is known, with the id of its task.
TASK = "(b[0-9a-z]{8})"
RECEIPTS = {
    "user": rf"^\s*Command was manually backgrounded by user with ID: {TASK}\. Output is being written to: (?:\S*[/\\])?\1(?:\.\S*)?(?:\s|$)",
    "message": rf"^\s*Command was moved to the background \(ID: {TASK}\) so that a message",
    "timeout": rf"^\s*Command did not complete within its [0-9]+s timeout and was moved to the background \(ID: {TASK}\)",
}
#: What stands before a task's id in the receipt of a call that asked for the background.
BEFORE_ID = ["with ID: ", "(task ", "(ID: "]


def questions(markers: DataFrame) -> DataFrame:
    """Questions without an answer: of each key the latest pending row, if the key is resolved nowhere.

    markers: key, phase (pending, resolved), ts, line_no and whatever else; rows without a time come last."""
    opened = markers.filter("phase = 'pending' AND key IS NOT NULL")
    latest = opened.groupBy("key").agg(F.max_by(F.struct(*markers.columns), F.struct(F.coalesce("ts", F.lit("")), "line_no")).alias("r")).select("r.*")
    closed = markers.filter("phase = 'resolved'").select("key").distinct()
    return latest.join(closed, "key", "left_anti").orderBy(F.asc_nulls_last("ts"), "line_no")


def background(tasks: DataFrame, carriers: DataFrame) -> DataFrame:
    """tasks with `state`: the last that a carrier tells of them, running if none does.

    tasks: session_id, call_id, task_id; carriers: session_id, line_no, call_id, task_id, state (null: a sign of life).
    A carrier names a task by its call or by its own id; both ways are equi-joins."""
    told = carriers.filter("state IS NOT NULL")
    ways = [told.filter(F.col(k).isNotNull()).groupBy("session_id", k).agg(F.max(F.struct("line_no", "state")).alias(f"__{k}")) for k in ("call_id", "task_id")]
    j = tasks.join(ways[0], ["session_id", "call_id"], "left").join(ways[1], ["session_id", "task_id"], "left")
    return j.select(*tasks.columns, F.coalesce(F.greatest("__call_id", "__task_id")["state"], F.lit("running")).alias("state"))


def agent_states(labelled: DataFrame, calls: DataFrame, results: DataFrame) -> DataFrame:
    """session_id, state: completed after a text that ends its turn, frozen on a call without a result, else running;
    sessions without a record of either side are unknown."""
    r = F.col("r")
    side = r["type"].isin("user", "assistant")
    newest = labelled.groupBy("session_id").agg(F.max_by(F.when(side, F.struct(r["type"].alias("type"), r["message"]["stop_reason"].alias("stop"), (F.col("text") != "").alias("said"), "line_no")), F.when(side, F.col("line_no"))).alias("n"))
    open_ = calls.join(results.select("session_id", "call_id").distinct(), ["session_id", "call_id"], "left_anti").select(F.col("session_id").alias("__s"), F.col("line_no").alias("open_line")).distinct()
    j = newest.join(open_, (F.col("session_id") == F.col("__s")) & (F.col("n.line_no") == F.col("open_line")), "left")
    ended = (F.col("n.type") == "assistant") & F.col("n.said") & (F.coalesce("n.stop", F.lit("")) != "tool_use")
    state = F.when(F.col("n").isNull(), "unknown").when(F.col("open_line").isNotNull(), "frozen").when(ended, "completed").otherwise("running")
    return j.select("session_id", state.alias("state"))


def after(text: Column, marker: str) -> Column:
    """The word after the first occurrence of a marker, up to white space, a comma, a closing bracket or the end of a
    sentence; null if there is none."""
    at = F.locate(marker, text)
    rest = F.substring(text, at + len(marker), F.length(text))
    word = F.regexp_replace(F.regexp_extract(rest, r"(?s)^(.*?)(?:(?U:\s)|,|\)|\.(?=[ \n])|$)", 1), r"\.+$", "")
    return F.when((at > 0) & (word != ""), word)


def receipt(text: Column) -> Column:
    """(entrance, task_id) if a result is the receipt of a shell that was moved to the background, as a whole sentence;
    a text that quotes the template is none. Null otherwise."""
    kinds = [F.when(text.rlike(pattern), F.struct(F.lit(kind).alias("entrance"), F.regexp_extract(text, pattern, 1).alias("task_id"))) for kind, pattern in RECEIPTS.items()]
    return F.coalesce(*kinds)


def launches(calls: DataFrame, results: DataFrame) -> DataFrame:
    """session_id, call_id, task_id, kind (shell, monitor, agent), entrance, command, description, launched, output: what
    went on in the background.

    Shells and monitors are known by their call; a shell that was moved there and an agent by the result. calls and
    results: as of classify, with ts. Of a call's results the first counts; a call without one has no task_id."""
    given = lambda k: F.get_json_object("input", f"$.{k}")
    told = lambda k: F.get_json_object("result", f"$.{k}")
    key = ["session_id", "call_id"]
    asked = (F.col("name").isin("Bash", "PowerShell") & (given("run_in_background") == "true")) | (F.col("name") == "Monitor")
    ours = calls.filter("call_id IS NOT NULL").select(*key, "name", F.coalesce(asked, F.lit(False)).alias("asked"), given("description").alias("description"), F.coalesce(given("command"), given("ws.url")).alias("command"), F.col("ts").alias("called"), "line_no")
    ours = ours.groupBy(*key).agg(F.min_by(F.struct("name", "asked", "description", "command", "called"), "line_no").alias("c")).select(*key, "c.*")
    text = F.coalesce(F.col("content"), F.lit(""))
    ack = F.coalesce(*[after(text, m) for m in BEFORE_ID], told("backgroundTaskId"), told("taskId"))
    agent = F.coalesce(told("status") == "async_launched", F.lit(False))
    got = results.filter("call_id IS NOT NULL").select(
        *key, "line_no", F.col("ts").alias("answered"), receipt(text).alias("moved"), ack.alias("ack"), after(text, "written to: ").alias("written"),
        F.when(agent, F.struct(told("agentId").alias("id"), told("description").alias("description"), told("outputFile").alias("output"))).alias("agent"),
    )
    # only the results of a call that asked, and those that tell of the background themselves, go on
    first = got.groupBy(*key).agg(F.min_by(F.struct("answered", "moved", "ack", "written", "agent"), "line_no").alias("r")).select(*key, "r.*")
    j = ours.join(first, key, "full").filter(F.col("asked") | F.col("moved").isNotNull() | F.col("agent").isNotNull())
    by_call = F.coalesce("asked", F.lit(False))
    moved = F.col("moved").isNotNull()
    return j.select(
        *key, F.when(by_call, F.col("ack")).when(moved, F.col("moved.task_id")).otherwise(F.col("agent.id")).alias("task_id"),
        F.when(by_call & (F.col("name") == "Monitor"), "monitor").when(by_call | moved, "shell").otherwise("agent").alias("kind"),
        F.when(by_call, F.when(F.col("name") != "Monitor", "model")).when(moved, F.col("moved.entrance")).alias("entrance"),
        F.when(by_call | moved, F.col("command")).alias("command"), F.when(by_call | moved, F.col("description")).otherwise(F.col("agent.description")).alias("description"),
        F.when(by_call, F.col("called")).when(moved, F.coalesce("called", "answered")).otherwise(F.col("answered")).alias("launched"),
        F.when(by_call | moved, F.col("written")).otherwise(F.col("agent.output")).alias("output"),
    )


def not_ignored(tasks: DataFrame, patterns: list[str]) -> DataFrame:
    """tasks with `ignored_by`: the first pattern that its command or description matches; null where it counts."""
    hit = lambda p: F.coalesce(F.col("command").rlike(p), F.lit(False)) | F.coalesce(F.col("description").rlike(p), F.lit(False))
    return tasks.withColumn("ignored_by", F.coalesce(*[F.when(hit(p), F.lit(p)) for p in patterns], F.lit(None).cast("string")))


def closed_counts(tasks: DataFrame) -> DataFrame:
    """How many tasks there are in each state, by kind."""
    return tasks.groupBy("kind", "state").agg(F.count(F.lit(1)).alias("n"))


def activity(labelled: DataFrame, lane: str = "session_id") -> DataFrame:
    """what, n, lanes: how often each thing happened and in how many lanes. records, thinking, agent_messages, user_prompts,
    notifications, and tool:NAME for the calls of each tool; nothing that didn't happen has a row."""
    kind = lambda x: (
        F.when(x.startswith("agent.thinking."), "thinking").when(x.startswith("agent.message."), "agent_messages").when(x == "user.message", "user_prompts").when(x.startswith("harness.notification"), "notifications")
    )
    tools = F.transform(F.filter("blocks", lambda b: b["type"] == "tool_use"), lambda b: F.concat(F.lit("tool:"), F.coalesce(b["name"], F.lit("(unnamed)"))))
    none = F.array().cast("array<string>")
    what = F.concat(F.array(F.lit("records")), F.coalesce(F.transform("labels", kind), none), F.coalesce(tools, none))
    rows = labelled.select(F.col(lane).alias("lane"), F.explode(what).alias("what")).filter("what IS NOT NULL")
    return rows.groupBy("what").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lane").alias("lanes"))


def last_messages(labelled: DataFrame, n: int) -> DataFrame:
    """The last n messages with text of each session and side: session_id, side (user, agent), place (1 is the last),
    line_no, ts, text."""
    side = F.when(F.exists("labels", lambda x: x == "user.message"), "user").when(F.exists("labels", lambda x: x.startswith("agent.message.")), "agent")
    said = labelled.select("session_id", side.alias("side"), "line_no", F.col("r.timestamp").alias("ts"), "text").filter("side IS NOT NULL AND text <> ''")
    # places are found on narrow rows; texts come back by line
    place = F.row_number().over(Window.partitionBy("session_id", "side").orderBy(F.desc("line_no")))
    last = said.select("session_id", "side", "line_no").withColumn("place", place).filter(F.col("place") <= n)
    return last.join(said, ["session_id", "side", "line_no"]).select("session_id", "side", "place", "line_no", "ts", "text")
