"""Functions over texts, ids, times and paths, by cases; needles; the line source over split files."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracelake.functions import diff, grammar, ids, paths, text, times
from tracelake.operators import graph, joins, search, verbatim
from tracelake.sources import transcripts


def values(spark, column, rows):
    df = spark.createDataFrame([(k, *(r if isinstance(r, tuple) else (r,))) for k, r in enumerate(rows)], "k long, " + ", ".join(f"{c} string" for c in "abc"[: len(rows[0]) if isinstance(rows[0], tuple) else 1]))
    return [r.v for r in df.select("k", column.alias("v")).orderBy("k").collect()]


@pytest.fixture(autouse=True)
def columns(spark):
    # columns need a session
    global A, B
    A, B = F.col("a"), F.col("b")


def test_tags(spark):
    rows = ["<link rel=x>nope</link><li>ok</li>", "<li>  </li><li>b</li>", "<li class=x>no</li>", "<li>open", None, "x<li>\n a\nb </li><li>c</li>"]
    assert values(spark, text.xml_tag(A, "li"), rows) == ["ok", None, None, None, None, "a\nb"]
    assert values(spark, text.xml_tags(A, "li"), rows) == [["ok"], ["b"], [], [], None, ["a\nb", "c"]]
    assert values(spark, text.xml_attribute(A, "id"), ['<a id=" x ">', '<a id="">', "<a>", None]) == ["x", None, None, None]


def test_small_texts(spark):
    assert values(spark, text.saved_path(A), ["x\nFull output saved to: /a/b \nmore", "Full output saved to:", "none"]) == ["/a/b", None, None]
    assert values(spark, text.newlines(A), ["a \n b", "\na\n\nb", "ab\n", "", "ab"]) == [[1], [0, 1, 1], [2], [], []]
    got = values(spark, text.gutter(A), [" 12\tx\n3\u2192y\tz\nno\n4 x"])
    assert [(r.line, r.text) for r in got[0]] == [(12, "x"), (3, "y\tz")]
    body = '- "Fix THE  bug" please\n- plain Bullet\nprose "Quoted here" end\n- ""\nnone'
    assert values(spark, text.summary_fingerprints(A), [body]) == [["fix the bug", "plain bullet", "quoted here"]]
    assert values(spark, text.took(A, B), [("2024-01-01T00:00:00Z", "2024-01-01T02:05:09Z"), ("2024-01-01T00:00:00Z", "2024-01-01T00:14:20Z"), ("2024-01-01T00:00:09Z", "2024-01-01T00:00:00Z"), (None, "x")]) == ["2h05m", "14m20s", "0s", None]
    assert values(spark, text.ranges(F.transform(F.split(A, ","), lambda x: x.cast("long"))), ["1,2,3,5", "7", "1,3,4"]) == ["1-3, 5", "7", "1, 3-4"]


def brute_windows(t, size):
    out, cur = [], ""
    for line in re.findall(r"[^\n]*\n|[^\n]+", t):
        if len(line) > size:
            if cur:
                out.append(cur)
            cur = ""
            while len(line) >= size:
                out.append(line[:size])
                line = line[size:]
            cur = line
            continue
        if cur and len(cur) + len(line) > size:
            out.append(cur)
            cur = ""
        cur += line
    return out + [cur] * bool(cur)


def test_windows(spark):
    rng = random.Random(5)
    rows = ["".join(rng.choice("ab\n\U0001F600" if k % 2 else "abc") for _ in range(rng.randrange(60))) for k in range(150)] + ["", "\n", "a\n" * 20]
    assert values(spark, text.windows(A, 9), rows) == [brute_windows(t, 9) for t in rows]


def test_ids(spark):
    rows = ["0123456789ab", "0123456789a", "aBob-0123456789ab", "a1b2c3d4-0000-0000-0000-0123456789ab", "aP1-x-1a2b3c4d5e6f7a8b"]
    assert values(spark, ids.is_agent_hex(A), rows) == [True, False, False, False, False]
    assert values(spark, ids.is_named_agent(A), rows) == [False, False, True, False, True]
    assert values(spark, ids.has_prefix(A, B), [("ab-cd", "abc"), ("abcd", "ab-c"), ("abcd", "b")]) == [True, True, False]
    assert values(spark, ids.utf16_units(A), ["a\U0001F600", "", None]) == [3, 0, None]
    assert values(spark, ids.folder_name(A), ["/a/b c", "C:\\x", "e\u0301", "\U0001F600", None]) == ["-a-b-c", "C--x", "-", "--", None]
    # the published first outputs for the states 0 and 1234567
    got = [v % 2**64 for v in values(spark, ids.splitmix64(A.cast("long")), ["0", "1234567"])]
    assert got == [0xE220A8397B1DCDAF, 6457827717110365317]


def test_times(spark):
    rows = ["2026-07-11T05:33:37.442Z", "2026-07-11T05:33:37+05:30", "2026-07-11T05:33:37", "soon", None]
    assert values(spark, times.epoch_ms(A), rows)[1:] == [1783728217000, None, None, None]
    assert values(spark, times.shown(A), rows) == ["2026-07-11 05:33:37 UTC(UTC+0)", "2026-07-11 00:03:37 UTC(UTC+0)", "2026-07-11T05:33:37 (unparsed)", "soon (unparsed)", "\u2014"]
    assert values(spark, times.shown(A, True), rows)[0] == "2026-07-11 05:33:37.442 UTC(UTC+0)"
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        assert values(spark, times.shown(A), rows)[0] == "2026-07-11 11:03:37 IST(UTC+05:30)"
        assert values(spark, times.local_iso(A), rows)[0] == "2026-07-11T11:03:37+05:30"
        assert values(spark, times.utc_of_seconds(A.cast("long")), ["0", "253402300800"]) == ["1970-01-01T00:00:00Z", None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert values(spark, times.closed_ms(A), ['{"startTime":5,"totalDuration":2.9}', '{"startTime":-1,"totalDuration":2}', "{}", "x"]) == [7, None, None, None]
    assert values(spark, times.expired(A, B), [("2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z"), ("x", "2024-01-01T00:00:00Z")]) == [True, False]


def test_paths(spark):
    rows = ["./a/lib.rs", "/p//q", "//srv/x", "///x", "a/./b/../c", "/a/b/", "a\\\\b", "."]
    assert values(spark, paths.normal(A), rows) == ["a/lib.rs", "/p/q", "//srv/x", "/x", "a/b/../c", "/a/b/", "a\\b", ""]
    assert values(spark, paths.names_file("b.rs", A), ["/x/b.rs", "/x/ab.rs", "b.rs", "x\\b.rs"]) == [True, False, True, True]
    assert values(spark, paths.parent(A), ["/a/b.rs", "/b", "b", "a/b/c"]) == ["/a", "/", ".", "a/b"]
    assert values(spark, paths.join(A, B), [("/a/b", "../c/./d"), ("C:\\x", "../../z/w"), ("/a", "../../.."), (None, "x"), ("/a", None)]) == ["/a/c/d", "C:\\z\\w", "/", None, "/a"]
    assert paths.join_text("\\\\srv\\sh\\d", ["..", "..", "q"]) == "\\\\srv\\sh\\q"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_distances(spark):
    rng = random.Random(9)
    rows = [("".join(rng.choice("abc") for _ in range(rng.randrange(20))), "".join(rng.choice("abcd") for _ in range(rng.randrange(20)))) for _ in range(200)]
    got = values(spark, diff.char_diff(A, B), rows)
    assert [(r.chars, r.exact) for r in got] == [(len(a) + len(b) - 2 * lcs(a, b), True) for a, b in rows]
    assert diff.distance("draft", "a draft that became far longer " * 90_000) == (31 * 90_000 - 5, True)
    assert diff.distance("zdraft", "q" * 300_000) == (299_994, False)
    for a, b in rows[:50]:
        x, y = list(a), list(b)
        pairs = diff.common(x, y)
        assert len(pairs) == lcs(x, y) and all(x[i] == y[j] for i, j in pairs) and pairs == sorted(pairs)


@pytest.mark.parametrize("pattern", ["TodoWrite.*legacy|legacy.*TodoWrite", "foo(bar)?baz", "(?:abc|abd)x+", "ab", "a|longer", "[xy]needle$", "C:.Users.dev", "(one|two)?three", "wor(?:ld|king)", "caf\u00e9 bar"])
def test_needles_lose_no_match(spark, pattern):
    rng = random.Random(1)
    words = ["TodoWrite", "legacy", "foo", "bar", "baz", "abc", "abd", "x", "longer", "a", "b", "needle", "C:", "Users", "dev", "one", "two", "three", "world", "working", "caf\u00e9", " "]
    rows = ["".join(rng.choice(words) for _ in range(4)) for _ in range(300)]
    rows += [r.upper() for r in rows[:50]]
    hits = values(spark, search.matches(A, pattern), rows)
    may = values(spark, grammar.may_match(A, pattern), rows)
    assert all(m for h, m in zip(hits, may, strict=True) if h)
    assert grammar.needles("(?i)abcdef") == [] and grammar.needles("a|bcd") == [] and grammar.needles('say "word"') == ["word"]


def test_selectors_and_faces():
    labels, hidden = ["user.message", "user.queued", "harness.turn.recap"], ["user.queued", "harness.turn.recap"]
    assert grammar.faces(labels) == ["user", "user.message", "user.queued", "harness", "harness.turn", "harness.turn.recap"]
    assert grammar.statically_empty(["harness"], [], labels, hidden) and not grammar.statically_empty(["harness.*"], [], labels, hidden)
    assert grammar.statically_empty(["user"], ["user.message"], labels, hidden)


def test_lines_of_split_files(spark, tmp_path):
    rng = random.Random(4)
    want = {}
    for name in ("s1", "s2", "s3"):
        rows = [f'{{"n":{k},"x":"{"y" * rng.randrange(200)}"}}' if rng.random() < 0.9 else rng.choice(["", "\r", " "]) for k in range(4000 if name == "s1" else 50)]
        (tmp_path / f"{name}.jsonl").write_bytes(("\n".join(rows) + ("\n" if name != "s2" else "")).encode())
        want |= {(name, k): v for k, v in enumerate(rows, 1)}
    (tmp_path / "empty.jsonl").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = transcripts.lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 10
        assert {(r.session_id, r.line_no): r.value for r in df.collect()} == want
        some = search.candidates(df, '"n":39[0-9]{2}')
        assert {(r.session_id, r.line_no) for r in some.collect()} >= {k for k, v in want.items() if re.search('"n":39[0-9]{2}', v)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_trees(spark):
    rng = random.Random(2)
    up = {k: rng.randrange(k) for k in range(1, 60)} | {k: k - 1 for k in range(100, 400)} | {900: 901, 901: 900}
    edges = spark.createDataFrame([(str(a), str(b)) for a, b in up.items()], "child string, parent string")

    def depth(n):
        d = 0
        while n in up:
            n, d = up[n], d + 1
        return d, n

    live = [n for n in [*up, 0, 99] if n not in (900, 901)]
    assert {int(r.node): r.depth for r in graph.depths(edges).collect()} == {n: depth(n)[0] for n in live}
    assert {int(r.node): r.step for r in graph.walk_up(edges, "399").collect()} == {399 - k: k for k in range(1, 301)}
    below = {n: d for n in range(101, 400) for d in [n - 100]}
    assert {int(r.node): r.depth for r in graph.closure(edges, ["100"]).collect()} == below
    tree = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("e", "b")], "child string, parent string")
    assert [(r.node, r.depth) for r in graph.preorder(tree).orderBy("rank").collect()] == [("b", 1), ("d", 2), ("e", 2), ("c", 1)]


def test_resends(spark):
    long = "A long message that says a lot, " * 4
    rows = [("s", 1, 1, long), ("s", 1, 2, long.upper() + "and more"), ("s", 1, 3, long + "and MORE yet"), ("s", 2, 4, long), (None, 1, 5, long), (None, 1, 6, long), ("s", 1, 7, "short"), ("s", 1, 8, "short and more"), ("s", 1, 9, None)]
    got = verbatim.superseded(spark.createDataFrame(rows, "s string, g long, l long, x string"), ["s", "g"], "l", F.col("x")).collect()
    assert {r.l: r.superseded_by for r in got} == {1: 3, 2: 3, 3: None, 4: None, 5: 6, 6: None, 7: None, 8: None, 9: None}


def test_nearest(spark):
    left = spark.createDataFrame([(1, "u", 10), (2, "u", 21), (3, "v", 5), (4, None, 1)], "i long, k string, m long")
    right = spark.createDataFrame([("u", 8, 70), ("u", 12, 71), ("u", 20, 73), ("u", 20, 72), ("u", 99, 74)], "k string, t long, v long")
    got = {r.i: (r.v_near, r.gap, r.tied) for r in joins.nearest(left, right, "k", "m", "t", "v").collect()}
    assert got == {1: (70, 2, True), 2: (72, 1, True), 3: (None, None, False), 4: (None, None, False)}
