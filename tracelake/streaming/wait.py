"""Live transcripts: conditions over lines that arrive, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelake.sources.transcripts import RECORD, identity

CONDITIONS = {
    "stop": "r.message.stop_reason = 'end_turn'",
    "question": "r.type = 'assistant' AND r.message.content LIKE '%AskUserQuestion%'",
    "notification": "r.type = 'user' AND r.message.content LIKE '<task-notification>%'",
}


def condition(name: str) -> Column:
    """`stop`, `question`, `notification`, `tool:NAME`, `write:PATH`."""
    if name in CONDITIONS:
        return F.coalesce(F.expr(CONDITIONS[name]), F.lit(False))
    kind, _, arg = name.partition(":")
    content = F.coalesce(F.col("r.message.content"), F.lit(""))
    if kind == "tool" and arg:
        return content.contains(f'"name":"{arg}"') & content.contains('"tool_use"')
    if kind == "write" and arg:
        return content.contains('"tool_use"') & content.rlike('"name":"(Write|Edit|MultiEdit)"') & content.contains(arg)
    raise ValueError(f"not a condition: {name!r}")


def arriving(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """Lines of files that arrive in a folder, as a stream."""
    raw = spark.readStream.format("text").option("lineSep", "\n").option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").load(folder)
    return raw.withColumn("path", F.col("_metadata.file_path")).select(*identity(F.col("path")), F.from_json("value", RECORD).alias("r"), "value")


def wait(spark: SparkSession, folder: str, until: list[str], checkpoint: str, table: str) -> StreamingQuery:
    """Events that meet one of the conditions, appended to a table in memory; runs over what is there, then ends."""
    lines = arriving(spark, folder)
    hits = F.filter(F.array(*[F.when(condition(c), F.lit(c)) for c in until]), lambda x: x.isNotNull())
    events = lines.withColumn("condition", F.explode(hits)).select("session_id", "condition", F.col("r.timestamp").alias("ts"))
    return events.writeStream.format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(lines: DataFrame, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """A stream's lines by session and window of event time; lines later than the watermark are dropped."""
    timed = lines.withColumn("ts", F.to_timestamp("r.timestamp")).filter("ts IS NOT NULL").withWatermark("ts", late)
    return timed.groupBy("session_id", F.window("ts", every).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("session_id", F.col("w.start").alias("start"), "n")
