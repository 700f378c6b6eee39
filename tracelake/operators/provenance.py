"""Relations between records of a transcript: one row for each relation, joined by uuid or call id within the session."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators import classify
from tracelake.functions import text


def named(labelled: DataFrame) -> DataFrame:
    """session_id, line_no, relation, uuid: what records say of other records by uuid."""
    r = F.col("r")
    meta = lambda p: F.get_json_object(r["compactMetadata"], p)
    fired = F.array_contains("labels", "harness.schedule.fire")
    under = (r["type"] == "attachment") | F.coalesce(r["isMeta"], F.lit(False))

    def edge(relation: str, uuid: Column, when: Column | None = None) -> Column:
        return F.struct(F.lit(relation).alias("relation"), (uuid if when is None else F.when(when, uuid)).alias("uuid"))

    edges = F.array(
        edge("parent", r["parentUuid"]),
        edge("attached_to", r["parentUuid"], under & ~fired),
        edge("fires", r["parentUuid"], fired),
        edge("leaf", r["leafUuid"], r["type"] == "last-prompt"),
        edge("precedes", r["logicalParentUuid"], r["subtype"] == "compact_boundary"),
        edge("preserves", meta("$.preservedSegment.headUuid"), r["subtype"] == "compact_boundary"),
        edge("preserves", meta("$.preservedSegment.tailUuid"), r["subtype"] == "compact_boundary"),
        edge("versions", F.get_json_object("value", "$.messageId"), r["type"] == "file-history-snapshot"),
        edge("wraps", r["parentUuid"], r["subtype"] == "local_command"),
        edge("interrupted", r["parentUuid"], F.exists("labels", lambda x: x.startswith("harness.interrupt."))),
    )
    return labelled.select("session_id", "line_no", F.inline(F.filter(edges, lambda e: e["uuid"].isNotNull())))


def edges(labelled: DataFrame) -> DataFrame:
    """session_id, line_no, relation, to_line (null if what is named isn't there)."""
    ids = labelled.filter("r.uuid IS NOT NULL").groupBy("session_id", F.col("r.uuid").alias("uuid")).agg(F.max("line_no").alias("to_line"))
    by_uuid = named(labelled).join(ids, ["session_id", "uuid"], "left").select("session_id", "line_no", "relation", "to_line")
    # an earlier line of a uuid is a replay of the last
    copies = labelled.select("session_id", "line_no", F.col("r.uuid").alias("uuid")).join(ids, ["session_id", "uuid"]).filter("line_no < to_line")
    replays = copies.select("session_id", "line_no", F.lit("replays").alias("relation"), "to_line")
    calls = classify.calls(labelled).groupBy("session_id", "call_id").agg(F.max("line_no").alias("to_line"))
    payload = F.get_json_object("r.attachment", "$.toolUseID")
    said = [
        classify.results(labelled).select("session_id", "line_no", F.lit("result_of").alias("relation"), "call_id"),
        labelled.select("session_id", "line_no", F.lit("for_tool_use").alias("relation"), payload.alias("call_id")),
        labelled.filter(F.ltrim("text").startswith("<task-notification>")).select("session_id", "line_no", F.lit("reports").alias("relation"), text.xml_tag(F.col("text"), "tool-use-id").alias("call_id")),
    ]
    by_call = reduce(DataFrame.unionByName, said).filter("call_id IS NOT NULL").join(calls, ["session_id", "call_id"], "left")
    return by_uuid.unionByName(replays).unionByName(by_call.select("session_id", "line_no", "relation", "to_line"))


def dangling(edges: DataFrame) -> DataFrame:
    """relation, named, missing: how many relations name something, and how many of it isn't there."""
    return edges.groupBy("relation").agg(F.count(F.lit(1)).alias("named"), F.count(F.when(F.col("to_line").isNull(), 1)).alias("missing"))
