"""Which rows of a transcript survive: a walk from the newest leaf over parents, session by session.

Sequential by nature, so a grouped map over the narrow columns of a session; texts never enter it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SURVIVAL = "session_id string, line_no long, survival string, kind string, survivor_line long, replay_of long"
REPAIR_MS = 5000
CONVERSATION = ("user", "assistant", "attachment", "system")


def _ms(ts) -> float:
    got = pd.to_datetime(ts, utc=True, errors="coerce", format="ISO8601")
    return float("nan") if got is pd.NaT or pd.isna(got) else got.value / 1e6


def survive(rows: list[dict], crossings: int = 3) -> Iterator[tuple]:
    """(line_no, survival, kind, survivor_line, replay_of) of one session's rows in line order."""
    line_of, last = {}, {}
    for k, r in enumerate(rows):
        if r["type"] in CONVERSATION and r["uuid"]:
            last[r["uuid"]] = k  # of equal uuids, the last line counts
    nodes = {k for k in last.values()}
    replay = {k: rows[last[r["uuid"]]]["line_no"] for k, r in enumerate(rows) if r["type"] in CONVERSATION and r["uuid"] and last[r["uuid"]] != k}
    main = [k for k in sorted(nodes) if not rows[k]["sidechain"]]
    parent = lambda k: last.get(rows[k]["parent"]) if rows[k]["parent"] else None
    # the recorded leaf, unless a later row goes on from it; else the last row
    leaf = None
    for r in rows:
        if r["type"] == "last-prompt" and r["leaf"]:
            leaf = last.get(r["leaf"])
        elif r["type"] == "last-prompt" and r["explicit"]:
            leaf = None
        elif r["subtype"] == "compact_boundary":
            leaf = None
    if main:
        tail, k, seen = main[-1], main[-1], set()
        while k is not None and k not in seen:
            seen.add(k)
            k = parent(k)
        leaf = tail if leaf is None or leaf in seen else leaf
    while leaf is not None and rows[leaf]["type"] not in ("user", "assistant"):
        leaf = parent(leaf)
    alive: set[int] = set()
    floor, k, budget = 0, leaf, crossings
    while k is not None and k not in alive:
        alive.add(k)
        floor = k
        up = parent(k)
        if up is None and rows[k]["parent"]:
            # the parent is missing: the nearest earlier row within the repair window takes its place
            at = _ms(rows[k]["ts"])
            near = [j for j in main if j < k and j not in alive and 0 <= at - _ms(rows[j]["ts"]) <= REPAIR_MS]
            up = max(near, key=lambda j: (_ms(rows[j]["ts"]), j), default=None)
        if up is None and rows[k]["logical"] and budget > 0:
            budget -= 1
            up = last.get(rows[k]["logical"])
        k = up
    # rows of the same message, results of their calls, and what hangs off the leaf without being conversation
    ids = {rows[k]["message_id"] for k in alive if rows[k]["type"] == "assistant" and rows[k]["message_id"]}
    alive |= {k for k in main if rows[k]["type"] == "assistant" and rows[k]["message_id"] in ids}
    grown = True
    while grown:
        more = {k for k in main if k not in alive and parent(k) in alive and (rows[k]["carrier"] or (rows[k]["type"] in ("attachment", "system")))}
        alive |= more
        grown = bool(more)
    children: dict[int, list[int]] = {}
    for k in main:
        if (p := parent(k)) is not None:
            children.setdefault(p, []).append(k)

    def answered(k: int) -> bool:
        todo, seen = [k], set()
        while todo:
            x = todo.pop()
            for c in children.get(x, ()):
                if rows[c]["type"] == "assistant":
                    return True
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        return False

    for k, r in enumerate(rows):
        if k not in nodes or r["sidechain"]:
            yield r["line_no"], "live", None, None, replay.get(k)
        elif k in alive:
            yield r["line_no"], "live", None, None, None
        elif k < floor:
            yield r["line_no"], "pre-cut", None, None, None
        else:
            kind = survivor = None
            if r["type"] == "user" and not r["carrier"]:
                kind = "rewound" if answered(k) else "draft"
                others = [c for c in children.get(parent(k), ()) if c in alive and rows[c]["type"] == "user" and not rows[c]["carrier"]]
                survivor = rows[others[-1]]["line_no"] if others else None
            yield r["line_no"], "abandoned", kind, survivor, None


def survival(spine: DataFrame, crossings: int = 3) -> DataFrame:
    """session_id, line_no, survival (live, pre-cut, abandoned), kind (draft, rewound), survivor_line, replay_of."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_no").astype(object)
        rows = pdf.where(pdf.notna(), None).to_dict("records")
        out = pd.DataFrame(list(survive(rows, crossings)), columns=["line_no", "survival", "kind", "survivor_line", "replay_of"])
        out.insert(0, "session_id", pdf["session_id"].iloc[0])
        return out.astype({"survivor_line": "Int64", "replay_of": "Int64"})

    return spine.groupBy("session_id").applyInPandas(one, SURVIVAL)


def reverse_closure(rows: DataFrame, seed: str) -> DataFrame:
    """session_id, line_no of rows that join a seed's uuid: in line order, once. A row joins if it is the seed; if its
    parent has joined and it opens no turn; or if it answers a call of a row that has joined.

    rows: session_id, line_no, uuid, parent, opens, calls (array of ids), answers (array of ids).
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        uuids, ids, out = set(), set(), []
        for r in pdf.sort_values("line_no").itertuples():
            if r.uuid == seed or (not r.opens and r.parent in uuids) or any(a in ids for a in (r.answers if r.answers is not None else ())):
                uuids.add(r.uuid)
                ids.update(r.calls if r.calls is not None else ())
                out.append((r.session_id, r.line_no))
        return pd.DataFrame(out, columns=["session_id", "line_no"])

    return rows.groupBy("session_id").applyInPandas(one, "session_id string, line_no long")


def with_survival(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Join the verdicts back to the wide rows, and give abandoned openers their label."""
    j = records.join(verdicts.select("session_id", "line_no", "survival", "kind", "survivor_line"), ["session_id", "line_no"], "left")
    label = F.when(F.col("kind") == "draft", F.array(F.lit("user.unsent"))).when(F.col("kind") == "rewound", F.array(F.lit("user.rewound")))
    return j.withColumn("labels", F.coalesce(label, F.col("labels"))) if "labels" in records.columns else j
