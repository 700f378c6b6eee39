"""Message selection, the planner, differences, provenance, images and what is open."""

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions import diff
from tracelake.operators import classify, images, live, provenance, verbatim
from tracelake.sources import transcripts


@pytest.mark.parametrize(
    ("text", "want"),
    [("let me look", False), ("all 12 tests are green", True), ("12 of the many rather old tests", False), ("3 of 4", True), ("a bug", True), ("see a/b.py:12", True), ("it is `x`", True), ("", False), ("x" * 280, True)],
)
def test_rich(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(verbatim.rich(F.col("t"))).first()[0] is want


def kept(spark, texts, mode, **more):
    rows = spark.createDataFrame([("s", k, t) for k, t in enumerate(texts)], "s string, k long, t string")
    return [(r.kept, r.dropped_run) for r in verbatim.select_messages(rows, ["s"], "k", "t", mode, **more).orderBy("k").collect()]


def test_selection(spark):
    texts = ["let me see", "a bug", "let me try", "i'll go", "ok then"]
    assert kept(spark, texts, "longest") == [(False, 1), (True, None), (True, None), (False, 2), (False, None)]
    assert [k for k, _ in kept(spark, ["aa", "bb", None], "longest")] == [False, True, False]  # of equal ones the last
    assert kept(spark, texts, "eot") == [(False, 4), (False, None), (False, None), (False, None), (True, None)]
    assert kept(spark, texts, "rich", threshold=3) == [(True, None), (True, None), (False, 2), (False, None), (True, None)]
    assert kept(spark, texts, "rich", threshold=3, keep_first=False)[0] == (False, 1)
    assert kept(spark, [], "all") == []
    with pytest.raises(ValueError):
        kept(spark, texts, "none")


def test_plan_stays_within_the_budget_and_skips():
    turn = lambda n, u, a, **m: {"turn": n, "user_cost": u, "agent_cost": a, "repeated": False, "crossed": 0} | m
    assert verbatim.plan([turn(3, 10, 10), turn(2, 500, 500), turn(1, 5, 5)], 100, 0.5, 0) == [(1, "both"), (3, "both")]
    assert verbatim.plan([turn(2, 90, 20)], 100, 0.5, 0) == [(2, "user")]
    assert verbatim.plan([turn(2, 30, 40)], 100, 0.5, 0) == [(2, "both")]  # too large for the share, but there is room
    assert verbatim.plan([turn(2, 30, 30, repeated=True), turn(1, 30, 30)], 70, 1.0, 0) == [(1, "both")]
    assert verbatim.plan([turn(2, 20, 20, crossed=1), turn(1, 20, 20, crossed=2)], 85, 1.0, 5) == [(1, "user"), (2, "both")]
    rng = random.Random(1)
    for _ in range(200):
        turns = [turn(n, rng.randrange(40), rng.randrange(40), repeated=rng.random() < 0.3, crossed=n // 3) for n in range(9, -1, -1)]
        got = dict(verbatim.plan(turns, 120, 0.5, 7))
        cost = sum((t["user_cost"] if got[t["turn"]] != "agent" else 0) + (t["agent_cost"] if got[t["turn"]] != "user" else 0) for t in turns if t["turn"] in got)
        assert cost + 7 * max([t["crossed"] for t in turns if t["turn"] in got], default=0) <= 120


def test_plan_budget(spark):
    turns = spark.createDataFrame([("s", 1, 1, 10, 10, False, 0), ("s", 2, 2, 10, None, False, 0), (None, 1, 1, 5, 5, None, 0)], "s string, turn long, latest_line long, user_cost long, agent_cost long, repeated boolean, crossed long")
    assert {(r.s, r.turn, r.sides) for r in verbatim.plan_budget(turns, "s", 100).collect()} == {("s", 1, "both"), ("s", 2, "user"), (None, 1, "both")}
    assert verbatim.plan_budget(turns.limit(0), "s", 100).count() == 0


def patched(old, patch):
    """Apply a unified diff."""
    out, at, lines = [], 0, diff.split(old)
    body = diff.split(patch)
    for k, row in enumerate(body):
        unended = k + 1 < len(body) and body[k + 1].startswith("\\")
        text = row[1:-1] if unended else row[1:]
        if row.startswith("@@"):
            begin, _, size = row.split()[1][1:].partition(",")
            first = int(begin) - (size != "0")
            out += lines[at:first]
            at = first
        elif row.startswith(" "):
            out.append(text)
            at += 1
        elif row.startswith("-"):
            assert lines[at] == text
            at += 1
        elif row.startswith("+"):
            out.append(text)
    return "".join(out + lines[at:])


def test_diffs_restore_the_new_text(spark):
    rng = random.Random(2)
    pairs = [(None, "a"), ("a", None), ("", ""), ("a\nb", "a\nb\n"), ("a\r\nb c\n", "a\nb d")]
    pairs += [tuple("".join(rng.choice("ab\n") for _ in range(rng.randrange(30))) for _ in "xy") for _ in range(100)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", diff.unified_diff(F.col("a"), F.col("b"), 1).alias("u"), diff.changed_spans(F.col("a"), F.col("b")).alias("c"))
    for r in df.collect():
        a, b = r.a or "", r.b or ""
        assert patched(a, r.u) == b
        for s in reversed(r.c):
            a = a[: s.begin] + s.text + a[s.end :]
        assert a == b


PNG = base64.b64encode(b"12345").decode()
ROWS = [
    {"type": "user", "uuid": "u1", "parentUuid": None, "message": {"role": "user", "content": [{"type": "text", "text": "see [Image #4]"}, {"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": PNG}}]}},
    {"type": "assistant", "uuid": "a1", "parentUuid": "u1", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "t1", "name": "Read", "input": {}}]}},
    {"type": "user", "uuid": "r1", "parentUuid": "a1", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "x"}]}},
    {"type": "attachment", "uuid": "h1", "parentUuid": "gone", "attachment": {"type": "hook_success", "toolUseID": "t1"}},
    {"type": "system", "uuid": "b1", "parentUuid": None, "logicalParentUuid": "r1", "subtype": "compact_boundary", "compactMetadata": {"preservedSegment": {"headUuid": "u1", "tailUuid": "r1"}}},
    {"type": "user", "uuid": "u1", "parentUuid": None, "message": {"role": "user", "content": [{"type": "text", "text": "see [Image #4]"}, {"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": PNG[:4] + "\n" + PNG[4:]}}]}},
    {"type": "last-prompt", "leafUuid": "r1"},
    {"type": "assistant", "uuid": "a2", "parentUuid": "r1", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "t2", "name": "Read", "input": {}}]}},
]


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("links")
    (d / "s1.jsonl").write_text("\n".join(map(json.dumps, ROWS)))
    (d / "s2.jsonl").write_text(json.dumps({"type": "mode"}) + "\n")
    done = {"type": "assistant", "uuid": "z", "message": {"role": "assistant", "stop_reason": "end_turn", "content": [{"type": "text", "text": "done"}]}}
    (d / "s3.jsonl").write_text(json.dumps(done))
    return classify.with_labels(transcripts.records(transcripts.lines(spark, str(d)))).cache()


def test_provenance(labelled):
    e = provenance.edges(labelled)
    got = {(r.line_no, r.relation, r.to_line) for r in e.collect()}
    assert got == {
        (2, "parent", 6), (3, "parent", 2), (8, "parent", 3), (4, "parent", None), (4, "attached_to", None), (4, "for_tool_use", 2), (3, "result_of", 2),
        (5, "precedes", 3), (5, "preserves", 6), (5, "preserves", 3), (1, "replays", 6), (7, "leaf", 3),
    }
    assert {(r.relation, r.named, r.missing) for r in provenance.dangling(e).collect()} >= {("parent", 4, 1), ("attached_to", 1, 1)}


def test_images(labelled):
    rows = images.listing(labelled)
    assert [(r.line_no, r.at, r.handle, r.format, r["size"]) for r in rows.orderBy("line_no").collect()] == [(1, 0, 4, "png", 5), (6, 0, 4, "png", 5)]
    assert [(r.line_no, r.shown) for r in images.latest(rows).collect()] == [(6, 2)]
    assert {bytes(r.content) for r in images.contents(labelled).collect()} == {b"12345"}


def test_agent_states(labelled):
    got = {r.session_id: r.state for r in live.agent_states(labelled, classify.calls(labelled), classify.results(labelled)).collect()}
    assert got == {"s1": "frozen", "s2": "unknown", "s3": "completed"}


def test_questions(spark):
    rows = [("a", "pending", None, 1), ("a", "pending", "2026", 2), ("b", "resolved", None, 1), ("b", "pending", None, 9), (None, "pending", None, 3), ("c", "odd", None, 4), ("d", "pending", None, 5)]
    got = live.questions(spark.createDataFrame(rows, "key string, phase string, ts string, line_no long")).collect()
    assert [(r.key, r.line_no) for r in got] == [("a", 2), ("d", 5)]
