"""Background launches and receipts, activity, copies of transcripts, records of hits."""

import json

from pyspark.sql import functions as F

from tracelake.operators import aggregate, classify, live, stats
from tracelake.sources import targets, transcripts


def values(spark, expr, rows):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], "a string").select(expr(F.col("a"))).collect()]


def test_receipts(spark):
    rows = [
        "Command was manually backgrounded by user with ID: b1234567a. Output is being written to: /t/b1234567a.out",
        "Command was manually backgrounded by user with ID: b1234567a. Output is being written to: /t/other.out",
        "Command was moved to the background (ID: bzzzzzzzz) so that a message could be read",
        "  Command did not complete within its 120s timeout and was moved to the background (ID: b00000000).",
        "Command did not complete within its xs timeout and was moved to the background (ID: b00000000).",
        "a note: Command was moved to the background (ID: bzzzzzzzz) so that a message",
        "Command was moved to the background (ID: ${e}) so that a message",
        None,
    ]
    got = [r and (r.entrance, r.task_id) for r in values(spark, live.receipt, rows)]
    assert got == [("user", "b1234567a"), None, ("message", "bzzzzzzzz"), ("timeout", "b00000000"), None, None, None, None]
    assert values(spark, lambda a: live.after(a, "to: "), ["x to: /a/b.c. Then", "to: a, b", "to: (x)", "to: ", "none", "to: f..", None]) == ["/a/b.c", "a", "(x", None, None, "f", None]


def test_launches(spark):
    calls = spark.createDataFrame(
        [
            ("s", 1, "c1", "Bash", json.dumps({"command": "sleep 9", "run_in_background": True, "description": "d"}), "t1"),
            ("s", 2, "c2", "Bash", json.dumps({"command": "make"}), "t2"),
            ("s", 3, "c3", "Monitor", json.dumps({"ws": {"url": "wss://x"}}), "t3"),
            ("s", 4, "c4", "Task", "{}", "t4"),
            ("s", 5, "c5", "Bash", json.dumps({"command": "ls"}), "t5"),
            ("s", 6, "c6", "Bash", json.dumps({"command": "never answered", "run_in_background": True}), None),
        ],
        "session_id string, line_no long, call_id string, name string, input string, ts string",
    )
    results = spark.createDataFrame(
        [
            ("s", 11, "c1", False, "Command running in background with ID: b11111111. Output is being written to: /t/b11111111.out", None, "r1"),
            ("s", 12, "c2", False, "Command was moved to the background (ID: b22222222) so that a message", None, "r2"),
            ("s", 13, "c3", False, "Monitor started (task b33333333, x)", None, "r3"),
            ("s", 14, "c4", False, "Async", json.dumps({"status": "async_launched", "agentId": "abc", "description": "look", "outputFile": "/o"}), "r4"),
            ("s", 15, "c5", False, "files", None, "r5"),
            ("s", 16, "lost", False, "Command was moved to the background (ID: b44444444) so that a message", None, "r6"),
        ],
        "session_id string, line_no long, call_id string, failed boolean, content string, result string, ts string",
    )
    got = {r.call_id: (r.task_id, r.kind, r.entrance, r.command, r.description, r.launched, r.output) for r in live.launches(calls, results).collect()}
    assert got == {
        "c1": ("b11111111", "shell", "model", "sleep 9", "d", "t1", "/t/b11111111.out"),
        "c2": ("b22222222", "shell", "message", "make", None, "t2", None),
        "c3": ("b33333333", "monitor", None, "wss://x", None, "t3", None),
        "c4": ("abc", "agent", None, None, "look", "r4", "/o"),
        "c6": (None, "shell", "model", "never answered", None, None, None),
        "lost": ("b44444444", "shell", "message", None, None, "r6", None),
    }
    tasks = live.not_ignored(live.launches(calls, results), ["^sleep", "look"])
    assert {r.call_id: r.ignored_by for r in tasks.collect()} == {"c1": "^sleep", "c2": None, "c3": None, "c4": "look", "c6": None, "lost": None}
    assert live.not_ignored(tasks, []).filter("ignored_by IS NOT NULL").count() == 0
    assert {(r.kind, r.n) for r in live.closed_counts(tasks.withColumn("state", F.lit("running"))).collect()} == {("shell", 4), ("monitor", 1), ("agent", 1)}


def test_activity_and_types(spark):
    user = lambda t: {"type": "user", "message": {"role": "user", "content": t}}
    rows = [user("one"), user("two"), {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "x"}, {"type": "tool_use", "id": "1", "name": "Bash", "input": {}}]}}, {"x": 1}]
    raw = [json.dumps(r) for r in rows] + ["", "{broken", "[1]"]
    lines = spark.createDataFrame([("s", "p", k, v) for k, v in enumerate(raw, 1)], "session_id string, path string, line_no long, value string")
    assert {(r.type, r.n) for r in stats.line_types(lines).collect()} == {("user", 2), ("assistant", 1), ("(untyped)", 1)}
    labelled = classify.with_labels(transcripts.records(lines.filter("line_no < 5")))
    assert {r.what: (r.n, r.lanes) for r in live.activity(labelled).collect()} == {"records": (4, 1), "agent_messages": (1, 1), "user_prompts": (2, 1), "tool:Bash": (1, 1)}
    assert live.activity(labelled.filter("line_no < 0")).count() == 0
    last = {(r.side, r.place, r.text) for r in live.last_messages(labelled, 1).collect()}
    assert last == {("user", 1, "two"), ("agent", 1, "x")}
    spans = spark.createDataFrame([(False, "a", "c"), (True, "b", "d"), (True, None, None)], "is_subagent boolean, first_ts string, last_ts string")
    assert tuple(stats.scope(spans).first()) == (1, 2, "a", "d")


def test_copies(spark):
    texts = {"/x/1": "a\nb\nc", "/y/1": "a\nb", "/x/2": "a\nb", "/y/2": "a\nb", "/x/3": "a\nbbb", "/y/3": "a\nb", "/x/4": "a\nb\nc", "/y/4": "a\nz", "/x/5": "a", "/x/6": "q", "/y/6": ""}
    found = spark.createDataFrame([(p, p[3:], False, len(t)) for p, t in texts.items()], "path string, session_id string, is_subagent boolean, bytes long")
    lines = spark.createDataFrame([(p, k, v) for p, t in texts.items() if t for k, v in enumerate(t.split("\n"), 1)], "path string, line_no long, value string")
    got = {r.path: (r.kept, r.relation, r.dropped) for r in targets.copies(found, lines).collect()}
    assert got == {
        "/x/1": ("/x/1", "prefix", False), "/y/1": ("/x/1", "prefix", True), "/x/2": ("/x/2", "identical", False), "/y/2": ("/x/2", "identical", True), "/x/3": ("/x/3", "prefix", False),
        "/y/3": ("/x/3", "prefix", True), "/x/4": ("/x/4", "divergent", False), "/y/4": ("/x/4", "divergent", False), "/x/6": ("/x/6", "prefix", False), "/y/6": ("/x/6", "prefix", True),
    }


def test_by_record(spark):
    hits = spark.createDataFrame([("s", 1, 0, None, "m"), ("s", 1, 1, "Bash", None), ("s", 2, 0, None, "m"), ("s", 0, 0, "Ask", None), ("s", 0, 0, "Ask", None)], "session_id string, line_no long, section int, tool string, model string")
    rows = aggregate.by_record(hits, ["tool", "model"])
    assert rows.count() == 4
    assert {(r.key, r.n) for r in aggregate.census(rows, F.col("tool")).collect()} == {("Bash", 1), ("Ask", 2)}
    assert tuple(aggregate.excluded(rows, F.col("tool")).first()) == (3, 1)
