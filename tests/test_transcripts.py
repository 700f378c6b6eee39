"""Operators over JSON-lines transcripts."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake.operators import chain, classify, files, stats
from tracelake.sources import transcripts
from tracelake.streaming import wait


def user(uuid, parent, text, ts="2026-06-07T05:00:00.000Z", **more):
    return {"type": "user", "uuid": uuid, "parentUuid": parent, "timestamp": ts, "message": {"role": "user", "content": text}} | more


def agent(uuid, parent, blocks, ts="2026-06-07T05:00:01.000Z", **message):
    return {"type": "assistant", "uuid": uuid, "parentUuid": parent, "timestamp": ts, "message": {"role": "assistant", "content": blocks} | message}


def call(uuid, parent, id_, name, **given):
    return agent(uuid, parent, [{"type": "tool_use", "id": id_, "name": name, "input": given}])


def result(uuid, parent, id_, content="ok", error=False, **more):
    return user(uuid, parent, [{"type": "tool_result", "tool_use_id": id_, "content": content, "is_error": error}], **more)


ROWS = [
    user("u1", None, "first question"),
    agent("a1", "u1", [{"type": "thinking", "thinking": "", "signature": "CAIS"}, {"type": "text", "text": "an answer"}], id="m1", model="x", usage={"input_tokens": 5, "output_tokens": 40}),
    agent("a2", "a1", [{"type": "text", "text": "more"}], id="m1", model="x", usage={"input_tokens": 0, "output_tokens": 0}),
    call("a3", "a2", "t1", "Write", file_path="/p/x.md", content="one\ntwo"),
    result("r1", "a3", "t1"),
    user("draft", "r1", "a draft"),
    user("u2", "r1", "what was sent"),
    call("a4", "u2", "t2", "Edit", file_path="/p/x.md", old_string="two", new_string="zwei\ndrei"),
    result("r2", "a4", "t2", toolUseResult={"filePath": "/p/x.md", "oldString": "two", "newString": "zwei\ndrei", "replaceAll": False}),
    call("a5", "r2", "t3", "Edit", file_path="/p/y.md", old_string="q", new_string="r"),
    result("r3", "a5", "t3", "no such string", error=True),
    call("a6", "r3", "t4", "Read", file_path="/p/z.md"),
    agent("a7", "a6", [{"type": "text", "text": "done"}], id="m2", model="x", stop_reason="end_turn", usage={"output_tokens": 2}),
    {"type": "mode", "mode": "plan"},
    {"type": "attachment", "uuid": "h1", "parentUuid": "a7", "attachment": {"type": "hook_success"}},
    {"type": "system", "uuid": "s1", "parentUuid": "a7", "subtype": "turn_duration", "durationMs": 5},
    user("c1", "a7", "<local-command-stdout>out</local-command-stdout>"),
    user("i1", "c1", "[Request interrupted by user]"),
    user("n1", "i1", "<task-notification><summary>Workflow done</summary></task-notification>"),
]


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    d = tmp_path_factory.mktemp("home")
    (d / "sub" / "s2" / "subagents").mkdir(parents=True)
    body = "\n".join(map(json.dumps, ROWS))
    (d / "s1.jsonl").write_text(body + '\n\n{"type":"user" broken\n')
    (d / "sub" / "s2" / "subagents" / "agent-abc.jsonl").write_text(json.dumps(user("x", None, "spawned")))
    (d / "empty.jsonl").write_text("")
    return str(d)


@pytest.fixture(scope="module")
def lines(spark, home):
    return transcripts.lines(spark, home).cache()


@pytest.fixture(scope="module")
def labelled(lines):
    return classify.with_labels(transcripts.records(lines)).cache()


def test_lines_keep_their_numbers(lines):
    got = lines.filter("session_id = 's1'").orderBy("line_no").collect()
    assert [r.line_no for r in got] == list(range(1, len(ROWS) + 3))
    sub = lines.filter("is_subagent").first()
    assert (sub.session_id, sub.parent_session_id) == ("abc", "s2")


def test_malformed_lines_are_counted(lines):
    assert {r.session_id: r.skipped_lines for r in transcripts.skipped(lines).collect()} == {"s1": 1, "abc": 0}


def test_labels(labelled):
    got = {r.uuid or r.type: (r.labels, r.opens) for r in labelled.filter("session_id = 's1'").select("r.uuid", "r.type", "labels", "opens").collect()}
    assert got["u1"] == (["user.message"], True)
    assert got["a1"][0] == ["agent.thinking.omitted", "agent.message.plain"]
    assert got["a3"] == (["agent.tool.use"], False)
    assert got["r1"] == (["agent.tool.result"], False)
    assert got["mode"][0] == ["harness.bookkeeping.mode"]
    assert got["h1"][0] == ["harness.hook.outcome"]
    assert got["s1"][0] == ["harness.turn.duration"]
    assert got["c1"] == (["harness.command.stdout"], False)
    assert got["i1"] == (["harness.interrupt.user"], False)
    assert got["n1"][0] == ["harness.notification.workflow"]


def test_bridge_visibility(labelled):
    rows = {(r.label, r.visible) for r in classify.bridge(labelled).collect()}
    assert ("user.message", True) in rows and ("harness.hook.outcome", False) in rows and ("agent.thinking.omitted", False) in rows


def test_survival(labelled):
    got = {r.line_no: r for r in chain.survival(transcripts.spine(labelled.filter("session_id = 's1'"))).collect()}
    draft = got[6]
    assert (draft.survival, draft.kind, draft.survivor_line) == ("abandoned", "draft", 7)
    assert all(r.survival == "live" for k, r in got.items() if k != 6)


def test_survival_rewound_and_replay():
    base = {"subtype": None, "sidechain": False, "logical": None, "leaf": None, "explicit": None, "message_id": None, "carrier": False, "ts": None}
    row = lambda n, t, u, p, **m: base | {"line_no": n, "type": t, "uuid": u, "parent": p} | m
    rows = [row(1, "user", "a", None), row(2, "user", "b", "a"), row(3, "assistant", "c", "b"), row(4, "user", "d", "a"), row(5, "assistant", "e", "d"), row(6, "assistant", "e", "d")]
    got = {r[0]: r for r in chain.survive(rows)}
    assert got[2][1:4] == ("abandoned", "rewound", 4)
    assert got[5][4] == 6 and got[6][1] == "live"


def test_survival_repairs_a_missing_parent():
    base = {"type": "user", "subtype": None, "sidechain": False, "logical": None, "leaf": None, "explicit": None, "message_id": None, "carrier": False}
    rows = [base | {"line_no": 1, "uuid": "a", "parent": None, "ts": "2026-01-01T00:00:00Z"}, base | {"line_no": 2, "uuid": "b", "parent": "gone", "ts": "2026-01-01T00:00:04Z"}]
    assert [r[1] for r in chain.survive(rows)] == ["live", "live"]
    rows[1]["ts"] = "2026-01-01T00:00:09Z"
    assert [r[1] for r in chain.survive(rows)] == ["pre-cut", "live"]


def test_reverse_closure(spark):
    rows = spark.createDataFrame(
        [("s", 1, "a", None, True, ["t1"], []), ("s", 2, "b", "a", False, [], ["t1"]), ("s", 3, "c", "b", True, [], []), ("s", 4, "d", "zz", False, [], ["t1"]), ("s", 5, "e", "d", False, [], [])],
        "session_id string, line_no long, uuid string, parent string, opens boolean, calls array<string>, answers array<string>",
    )
    assert sorted(r.line_no for r in chain.reverse_closure(rows, "a").collect()) == [1, 2, 4, 5]


def test_usage_counts_a_message_once(labelled):
    row = stats.usage(labelled).collect()
    assert [(r.output_tokens, r.input_tokens, r.messages) for r in row] == [(42, 5, 2)]


def test_tools(labelled):
    got = {r.name: (r.calls, r.failures, r.pending) for r in stats.tools(classify.calls(labelled), classify.results(labelled)).collect()}
    assert got == {"Write": (1, 0, 0), "Edit": (2, 1, 0), "Read": (1, 0, 1)}


def test_mutations_drop_failed_calls(labelled):
    m = files.mutations(classify.calls(labelled), classify.results(labelled))
    assert sorted((r.path, r.operation) for r in m.collect()) == [("/p/x.md", "edit"), ("/p/x.md", "write")]
    r = files.rollup(m, 2).first()
    assert (r.bucket, r.n, r.write, r.edit, r.files) == ("/p", 2, 1, 1, 1)


def test_recover(labelled):
    events = files.file_events(classify.calls(labelled), classify.results(labelled))
    assert {r.path: r.text for r in files.recover(events).collect()}["/p/x.md"] == "one\nzwei\ndrei"
    assert {r.path: r.text for r in files.recover(events, until_line=6).collect()}["/p/x.md"] == "one\ntwo"


def test_replay_never_makes_up_lines():
    known, whole, holes, hard = files.replay([{"event": "read", "text": "b\nc", "start": 2, "total": 9}, {"event": "edit", "old": "a\nb", "new": "x", "every": False}])
    assert (known, whole, holes, hard) == ({2: "b", 3: "c"}, None, 1, 0)


def test_wait(spark, home, tmp_path):
    q = wait.wait(spark, home, ["stop", "tool:Write"], f"file://{tmp_path}/cp", "waited")
    q.awaitTermination(60)
    assert sorted((r.session_id, r.condition) for r in spark.table("waited").collect()) == [("s1", "stop"), ("s1", "tool:Write")]


def test_blocks_of_plain_text(spark):
    df = spark.createDataFrame([("hi",), ('[{"type":"text","text":"yo"}]',), (None,)], "c string")
    assert [r[0] for r in df.select(F.coalesce(transcripts.flat_text(transcripts.blocks(F.col("c"))), F.lit("-"))).collect()] == ["hi", "yo", "-"]
