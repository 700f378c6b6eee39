"""Gates before parsing, targets, agents and their tree, patches and gaps."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tracelake.functions import gates, text
from tracelake.operators import agents, files
from tracelake.sources import targets

S1, S2, S3 = "11111111-0000-0000-0000-000000000001", "22222222-0000-0000-0000-000000000001", "22222222-0000-0000-0000-000000000002"
A1, A2 = "aaaa11112222", "bbbb33334444"


def kept(spark, rows, test):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], "value string").select(test(F.col("value"))).collect()]


def test_gates(spark):
    rows = [
        '{"message":{"role":"user"}}',
        '{"message":{"role" : "assistant"}}',
        '{"content":"\\"role\\":\\"user\\""}',
        '{"message":{"role":"assistant","content":[{"name":"AskUserQuestion"}]}}',
        '{"type":"system","subtype":"compact_boundary"}',
        '{"content":"compact_boundary"}',
        '{"type":"attachment","attachment":{"type":"plan_mode"}}',
        '{"continuedInSessionId":"x"}',
    ]
    assert kept(spark, rows, lambda v: gates.has_role(v, "user")) == [True] + [False] * 7
    assert kept(spark, rows, lambda v: gates.admits(v, "files")) == [True, False, False, True, False, False, False, False]
    assert kept(spark, rows, lambda v: gates.admits(v, "stats")) == [True, True, False, True, False, False, False, False]
    assert kept(spark, rows, lambda v: gates.admits(v, "sessions")) == [True, True, False, True, False, False, False, True]
    assert kept(spark, rows, lambda v: gates.admits(v, "plans")) == [False] * 6 + [True, False]
    assert kept(spark, rows, lambda v: gates.searched(v, ["boundaries"])) == [True, True, False, True, True, False, False, False]
    assert kept(spark, rows, lambda v: gates.searched(v, ["attachments"])) == [True, True, False, True, False, False, True, False]
    for reader in gates.NEEDLES:
        assert kept(spark, [""], lambda v, reader=reader: gates.admits(v, reader)) == [False]


def test_tokens():
    kinds = {
        "@main": "self", f"@{S1}": "session", "@1111": "prefix", "@11111111-0": "prefix", f"@{A1}": "agent", "@aBob-x-0123456789ab": "agent", "@bob@crew": "teammate",
        "@-Users-x": "folder", "@C--x": "folder", "@trap:marker": "marker", "/p/x": "path", "a/b.jsonl": "file",
    }
    assert {t: targets.parse(t).kind for t in kinds} == kinds
    for bad in ("@abc", "@x!", "@", S1, "1111", A1):
        with pytest.raises(ValueError):
            targets.parse(bad)
    assert [targets.pins_one(t) for t in ("@main", "@1111", "/p", "@-p", "x.jsonl", "@zz")] == [True, True, False, False, True, False]
    assert targets.listed(f"@{S1}\n 1111\t{A1}") == [f"@{S1}", "@1111", f"@{A1}"]
    with pytest.raises(ValueError):
        targets.listed("nothing")


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    d = tmp_path_factory.mktemp("store")
    for folder, session, agent in (("-p-x", S1, A1), ("-p-x", S2, A2), ("-p-y", S3, None)):
        (d / folder).mkdir(exist_ok=True)
        (d / folder / f"{session}.jsonl").write_text("{}\n")
        if agent:
            (d / folder / session / "subagents").mkdir(parents=True)
            (d / folder / session / "subagents" / f"agent-{agent}.jsonl").write_text('{"type":"tool_use","name":"Bash","input":"echo my-marker:1"}\n')
    return str(d)


def test_select(spark, store):
    found = targets.files(spark, store).cache()
    assert {(r.folder, r.session_id, r.is_subagent, r.parent_session_id) for r in found.collect()} == {
        ("-p-x", S1, False, None), ("-p-x", A1, True, S1), ("-p-x", S2, False, None), ("-p-x", A2, True, S2), ("-p-y", S3, False, None)
    }
    some = lambda tokens, **more: {r.session_id for r in targets.select(found, tokens, **more).collect()}
    assert some([]) == {S1, S2, S3, A1, A2}
    assert some([], with_agents=False) == {S1, S2, S3}
    assert some([f"@{S1}"]) == {S1, A1}
    assert some(["@1111"], with_agents=False) == {S1}
    assert some(["@aaaa"]) == {A1}
    assert some([f"@{A2}", f"@{S3}"]) == {A2, S3}
    assert some(["@-p-y"]) == {S3} == some(["/p/y"])
    assert some(["@main"], current=S3) == {S3}
    assert some([f"{S3}.jsonl"]) == {S3}
    tree = spark.createDataFrame([(A1, None), (A2, A1)], "agent_id string, parent_agent_id string")
    assert some([f"@{A1}"], nodes=tree) == {A1, A2}
    assert some([f"@{A1}"], nodes=tree, with_agents=False) == {A1}
    for wrong in (["@2222"], ["@9999"], ["@main"], ["@11111111-0000-0000-0000-00000000000f"], ["@cccc33334444"], ["@-p-x", f"@{S3}"]):
        with pytest.raises(LookupError):
            targets.select(found, wrong)


def test_marker(spark, store):
    lines = spark.read.option("recursiveFileLookup", "true").text(store).select("value", F.lit("p").alias("path"), F.lit(A1).alias("session_id"), F.lit(True).alias("is_subagent"), F.lit(1).alias("line_no"))
    assert targets.marked(lines, "my-marker:1").count() == 1
    assert targets.marked(lines, "my-marker:2").count() == 0
    with pytest.raises(ValueError):
        targets.marked(lines, 'a"b c d')


CALL = "session_id string, issuer string, line_no long, call_id string, name string, input string, ts string"
AGENT = "session_id string, agent_id string, kind string, name string, team string, spawn_id string, started string, last_activity string, agent_type string, description string, meta_parent string"


def test_tree(spark):
    given = lambda **k: json.dumps(k)
    calls = spark.createDataFrame(
        [
            ("s", None, 1, "c1", "Task", given(description="look", subagent_type="scout"), "2026-01-01T00:00:00Z"),
            ("s", "x1", 5, "c2", "Agent", given(name="bob", subagent_type="qa"), "2026-01-01T00:01:00Z"),
            ("s", "x1", 9, "c3", "Agent", given(name="bob"), "2026-01-01T00:05:00Z"),
            ("s", "x4", 1, "c1", "Task", given(description="copied"), "2026-01-01T00:00:00Z"),  # a clone repeats its parent's calls
            ("s", None, 7, "c9", "Bash", "{}", "2026-01-01T00:00:00Z"),
        ],
        CALL,
    )
    spawned = agents.spawns(calls)
    assert {(r.spawn_id, r.issuer, r.description) for r in spawned.collect()} == {("c1", None, "look"), ("c2", "x1", None), ("c3", "x1", None)}
    rows = [
        ("s", "x1", "builtin", None, None, "c1", "2026-01-01T00:00:01Z", "2026-01-01T09:00:00Z", None, None, None),
        ("s", "x2", "teammate", "bob", "t", None, "2026-01-01T00:02:00Z", None, "bob", None, None),
        ("s", "x3", "teammate", "bob", "t", None, "2025-01-01T00:00:00Z", None, "bob", None, "x2"),
        ("s", "x4", "builtin", None, None, None, "2026-01-01T00:02:00Z", None, "fork", "d", "x4"),
        ("s", "x5", "workflow", None, None, None, None, None, None, None, "x6"),
        ("s", "x6", "workflow", None, None, None, None, None, None, None, "x5"),
        ("s", "x7", None, None, None, "gone", None, None, None, None, "nowhere"),
    ]
    got = agents.nodes(spark.createDataFrame(rows, AGENT), spawned).cache()
    by = {r.agent_id: r for r in got.collect()}
    assert len(by) == got.count() == 7
    assert {k: (r.parent_agent_id, r.depth) for k, r in by.items()} == {
        "x1": (None, 0), "x2": ("x1", 1), "x3": ("x2", 2), "x4": (None, 0), "x5": ("x6", 65), "x6": ("x5", 65), "x7": ("nowhere", 1)
    }
    assert (by["x2"].spawn_id, by["x2"].agent_type, by["x3"].spawn_id, by["x1"].agent_type, by["x1"].trigger) == ("c2", "qa", "c2", "scout", "2026-01-01T00:00:00Z")
    assert {r.agent_id for r in agents.subtree(got, ["x1"]).collect()} == {"x1", "x2", "x3"}
    some = lambda **k: {r.agent_id for r in agents.admitted(got, **k).collect()}
    assert some(kinds=["workflow"]) == {"x5", "x6"}
    assert some(types=["qa", "scout"]) == {"x1", "x2", "x3"}
    assert len(some()) == 7
    assert some(axis="last_activity", since=datetime(2026, 1, 1, tzinfo=timezone.utc)) == {"x1"}
    results = spark.createDataFrame([("s", "c1", 2, "Async agent launched: x1"), ("s", "c2", 3, "all well")], "session_id string, call_id string, line_no long, content string")
    own = "session_id string, agent_id string, text string"
    back = agents.returned(got, results, spark.createDataFrame([("s", "x1", "last words"), ("s", "x5", "no")], own), spark.createDataFrame([("s", "x5", "entry")], own))
    assert {r.agent_id: (r.source, r.returned) for r in back.collect()} == {
        "x1": ("tail", "last words"), "x2": ("result", "all well"), "x3": ("result", "all well"), "x4": (None, None), "x5": ("journal", "entry"), "x6": (None, None), "x7": (None, None)
    }


def test_empty_tree(spark):
    empty = agents.nodes(spark.createDataFrame([], AGENT), agents.spawns(spark.createDataFrame([], CALL)))
    assert empty.count() == 0


def test_gaps(spark):
    rows = [([1, 2, 5], 7), ([2], None), ([], 3), ([], None), ([1, 2], 2), ([1, 4], 2)]
    df = spark.createDataFrame(rows, "a array<long>, n long")
    got = [[(g["first"], g["last"]) for g in r[0]] for r in df.select(text.gaps(F.col("a"), F.col("n"))).collect()]
    assert got == [[(3, 4), (6, 7)], [(1, 1)], [(1, 3)], [], [], [(2, 3)]]


def hunk(start, lines):
    return {"oldStart": start, "oldLines": sum(x[0] in " -" for x in lines), "newLines": sum(x[0] in " +" for x in lines), "lines": lines}


def test_patches():
    known = dict(enumerate("abcdef", 1))
    assert files.patched(known, [hunk(2, [" b", "-c", "+C", "+D"])]) == dict(enumerate("abCDdef", 1))
    # later hunks name places before the earlier ones shifted them
    assert files.patched(known, [hunk(1, ["-a"]), hunk(6, ["-f", "+F"])]) == dict(enumerate("bcdeF", 1))
    assert files.patched(known, [hunk(2, ["-x", "+y"])]) is None  # other lines stand there
    assert files.patched({1: "a"}, [hunk(9, ["-x"])]) is None
    assert files.patched({1: "a", 5: "e"}, [hunk(1, [" a", "+b"])]) == {1: "a", 2: "b", 6: "e"}
    assert files.patched({1: "a"}, [hunk(9, ["+x"])]) is None  # nothing known near it
    assert [files.hunks_of(x) for x in (None, "", "no", "{}", '[{"oldStart":1}]')] == [[]] * 5
    event = {"event": "write", "text": "a\nb", "start": 1, "total": None, "old": None, "new": None, "every": False, "patch": None}
    edit = event | {"event": "edit", "patch": json.dumps([hunk(2, ["-b", "+B", "+C"])])}
    assert files.replay([event, edit]) == ({1: "a", 2: "B", 3: "C"}, 3, 0, 0)
    assert files.replay([event, edit, edit])[2] == 1


def test_recover_gaps(spark):
    cols = "session_id string, path string, line_no long, event string, text string, start long, total long, old string, new string, every boolean, patch string"
    rows = [("s", "/a", 1, "read", "x\ny", 3, 9, None, None, False, None), ("s", "/b", 1, "write", "x", 1, None, None, None, False, None)]
    got = {r.path: (r.text, [tuple(g) for g in r.gaps]) for r in files.recover(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"/a": (None, [(1, 2), (5, 9)]), "/b": ("x", [])}
