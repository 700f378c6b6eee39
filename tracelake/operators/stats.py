"""Session facts: line counts, token usage counted once a message, tools, spans, and a total row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.aggregate import deduped_usage

FIELDS = ["input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"]


def usage(records: DataFrame) -> DataFrame:
    """session_id, model, token sums: of rows that share a message the largest of each field, once."""
    u = F.col("r.message.usage")
    rows = records.filter(u.isNotNull()).select("session_id", F.col("r.message.model").alias("model"), F.col("r.message.id").alias("message_id"), *[F.coalesce(u[f], F.lit(0)).alias(f) for f in FIELDS])
    return deduped_usage(rows, ["session_id", "model"], "message_id", FIELDS)


def sessions(records: DataFrame) -> DataFrame:
    """One row for each session: lines, line types, first and last time."""
    return records.groupBy("session_id").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("r.type").alias("types"), F.min("r.timestamp").alias("first_ts"), F.max("r.timestamp").alias("last_ts"))


def tools(calls: DataFrame, results: DataFrame) -> DataFrame:
    """By session and tool: calls, failures, and calls without a result."""
    once = results.groupBy("session_id", "call_id").agg(F.max("failed").alias("failed"))
    j = calls.join(once, ["session_id", "call_id"], "left")
    return j.groupBy("session_id", "name").agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(F.col("failed"), 1)).alias("failures"), F.count(F.when(F.col("failed").isNull(), 1)).alias("pending"))


def line_types(lines: DataFrame) -> DataFrame:
    """session_id, type, n: all lines that are JSON objects, by type; those without one are (untyped)."""
    kind = F.coalesce(F.expr("try_variant_get(try_parse_json(value), '$.type', 'string')"), F.lit("(untyped)"))
    objects = lines.filter(F.ltrim("value").startswith("{") & F.expr("try_parse_json(value) IS NOT NULL"))
    return objects.groupBy("session_id", kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))


def scope(sessions: DataFrame) -> DataFrame:
    """One row: how many sessions and agents, and the first and last time of all. sessions: is_subagent, first_ts, last_ts."""
    return sessions.agg(F.count(F.when(~F.col("is_subagent"), 1)).alias("sessions"), F.count(F.when(F.col("is_subagent"), 1)).alias("agents"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
