"""Files in transcripts: mutations, rollups, and replay of a file's events to its content at a point in time."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import text as texts

WRITERS = {"Write": "write", "Edit": "edit", "MultiEdit": "multi-edit", "NotebookEdit": "notebook-edit"}


def mutations(calls: DataFrame, results: DataFrame) -> DataFrame:
    """session_id, line_no, path, operation: calls that write a file, without those whose result is an error."""
    path = F.coalesce(F.get_json_object("input", "$.file_path"), F.get_json_object("input", "$.notebook_path"))
    table = F.create_map(*[F.lit(x) for kv in WRITERS.items() for x in kv])
    wrote = calls.withColumn("operation", F.element_at(table, F.col("name"))).withColumn("path", path).filter("operation IS NOT NULL AND path IS NOT NULL")
    failed = results.filter("failed").select("session_id", "call_id").distinct()
    return wrote.join(failed, ["session_id", "call_id"], "left_anti").select("session_id", "line_no", "path", "operation")


def rollup(mutations: DataFrame, depth: int | None = None) -> DataFrame:
    """By file, or by the first `depth` segments of the path: counts by operation, files, sessions, first and last line."""
    bucket = F.col("path") if depth is None else F.array_join(F.slice(F.split("path", "/", -1), 1, depth), "/")
    counts = [F.count(F.when(F.col("operation") == v, 1)).alias(v.replace("-", "_")) for v in WRITERS.values()]
    return mutations.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *counts, F.countDistinct("path").alias("files"), F.countDistinct("session_id").alias("sessions"))


def file_events(calls: DataFrame, results: DataFrame) -> DataFrame:
    """session_id, path, line_no, event, and what each carries: whole writes, reads, edits, integrity errors."""
    j = results.join(calls.select("session_id", "call_id", "name", "input"), ["session_id", "call_id"])
    path = F.get_json_object("input", "$.file_path")
    at = lambda p: F.get_json_object("result", p)
    event = (
        F.when(F.col("failed") & F.col("content").contains("modified since read"), "modified_since_read")
        .when(F.col("failed"), None)
        .when(F.col("name") == "Write", "write")
        .when(F.col("name") == "Edit", "edit")
        .when((F.col("name") == "Read") & at("$.file.content").isNotNull(), "read")
    )
    return j.select(
        "session_id", path.alias("path"), "line_no", event.alias("event"), F.coalesce(at("$.file.content"), F.get_json_object("input", "$.content")).alias("text"),
        F.coalesce(at("$.file.startLine").try_cast("long"), F.lit(1)).alias("start"), at("$.file.totalLines").try_cast("long").alias("total"),
        F.coalesce(at("$.oldString"), F.get_json_object("input", "$.old_string")).alias("old"), F.coalesce(at("$.newString"), F.get_json_object("input", "$.new_string")).alias("new"),
        F.coalesce(at("$.replaceAll").try_cast("boolean"), F.lit(False)).alias("every"), at("$.structuredPatch").alias("patch"),
    ).filter("event IS NOT NULL AND path IS NOT NULL")


def replay(events: Iterable[dict]) -> tuple[dict[int, str], int | None, int, int]:
    """Known lines, number of lines if the whole is known, edits that found no place, hard boundaries."""
    known: dict[int, str] = {}
    whole: int | None = None
    holes = hard = 0
    for e in events:
        if e["event"] == "write":
            known = dict(enumerate((e["text"] or "").split("\n"), 1))
            whole = len(known)
        elif e["event"] == "read":
            part = (e["text"] or "").split("\n")
            if e["start"] == 1 and e["total"] in (None, len(part)):
                known, whole = dict(enumerate(part, 1)), len(part)
            else:
                known |= dict(enumerate(part, int(e["start"])))
        elif e["event"] == "modified_since_read":
            known, whole, hard = {}, None, hard + 1
        elif e["event"] == "edit":
            if hunks := hunks_of(e.get("patch")):
                fresh = patched(known, hunks)
                holes += fresh is None
                if fresh is not None:
                    known = fresh
                    whole = whole + sum(h["newLines"] - h["oldLines"] for h in hunks) if whole is not None else None
                continue
            old, new = e["old"] or "", e["new"] or ""
            # within runs of neighbouring known lines only: nothing is made up between them
            done = False
            for first, text in runs(known):
                if not old or old not in text:
                    continue
                fresh = (text.replace(old, new) if e["every"] else text.replace(old, new, 1)).split("\n")
                size = text.count("\n") + 1
                shift = len(fresh) - size
                known = {n: t for n, t in known.items() if n < first} | dict(enumerate(fresh, first)) | {n + shift: t for n, t in known.items() if n >= first + size}
                whole = whole + shift if whole is not None else None
                done = True
                break
            holes += not done
    return known, whole, holes, hard


def hunks_of(patch: str | None) -> list[dict]:
    """The hunks of a structured patch; none if it isn't one."""
    try:
        hunks = json.loads(patch) if patch else []
    except ValueError:
        return []
    numbers = ("oldStart", "oldLines", "newLines")
    fit = isinstance(hunks, list) and all(isinstance(h, dict) and all(isinstance(h.get(k), int) and h[k] >= 0 for k in numbers) and isinstance(h.get("lines"), list) for h in hunks)
    return hunks if fit else []


def patched(known: dict[int, str], hunks: list[dict]) -> dict[int, str] | None:
    """Known lines after hunks that name their places; null, and nothing done, if one doesn't fit. A hunk fits if the lines
    it replaces are known and are what it says, and a line it stands on or next to is known."""
    shift = 0
    for h in hunks:
        size = h["oldLines"]
        first = max(h["oldStart"] + shift, 1)
        was = [x[1:] for x in h["lines"] if x[:1] in (" ", "-")]
        now = [x[1:] for x in h["lines"] if x[:1] in (" ", "+")]
        held = [known.get(n) for n in range(first, first + size)]
        if None in held or not any(n in known for n in range(first - 1, first + size + 1)) or (len(was) == size and was != held):
            return None
        grown = len(now) - size
        known = {n: t for n, t in known.items() if n < first} | dict(enumerate(now, first)) | {n + grown: t for n, t in known.items() if n >= first + size}
        shift += h["newLines"] - size
    return known


def runs(known: dict[int, str]) -> list[tuple[int, str]]:
    """Runs of neighbouring lines: where each begins, and its text."""
    out: list[tuple[int, list[str]]] = []
    for n in sorted(known):
        if out and out[-1][0] + len(out[-1][1]) == n:
            out[-1][1].append(known[n])
        else:
            out.append((n, [known[n]]))
    return [(n, "\n".join(t)) for n, t in out]


def recover(events: DataFrame, until_line: int | None = None) -> DataFrame:
    """path, text (null where lines are missing), known_lines, holes, boundaries, gaps (runs of missing lines up to the last
    that is known or was told): each file as it was after a line."""
    if until_line is not None:
        events = events.filter(F.col("line_no") <= until_line)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["session_id", "line_no"]).astype(object)
        known, whole, holes, hard = replay(pdf.where(pdf.notna(), None).to_dict("records"))
        full = whole is not None and set(known) == set(range(1, whole + 1))
        told = pdf["total"].dropna()
        row = (pdf["path"].iloc[0], "\n".join(known[n] for n in sorted(known)) if full else None, len(known), holes, hard, sorted(known), whole or (int(told.iloc[-1]) if len(told) else None))
        return pd.DataFrame([row], columns=["path", "text", "known_lines", "holes", "boundaries", "at", "total"])

    done = events.groupBy("path").applyInPandas(one, "path string, text string, known_lines long, holes long, boundaries long, at array<long>, total long")
    return done.withColumn("gaps", texts.gaps(F.col("at"), F.col("total"))).drop("at", "total")
