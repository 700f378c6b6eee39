"""Transcripts: JSON lines, addressed by file and physical line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Members of a line that the operators read; all else stays in `value`. A wrong type reads as null, never as an error.
RECORD = """type string, uuid string, parentUuid string, timestamp string, sessionId string, cwd string, version string, gitBranch string,
isSidechain boolean, isCompactSummary boolean, isMeta boolean, isVirtual boolean, isVisibleInTranscriptOnly boolean, isApiErrorMessage boolean,
subtype string, content string, leafUuid string, explicit boolean, logicalParentUuid string, operation string,
compactMetadata string, attachment string, toolUseResult string, snapshot string, rendered string,
message struct<role:string,content:string,model:string,stop_reason:string,id:string,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>>"""

BLOCK = """array<struct<type:string,text:string,thinking:string,signature:string,data:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean,source:struct<type:string,media_type:string,data:string>>>"""


#: Blocks of files whose first line numbers are broadcast at most (24 bytes each).
BLOCKS = 1 << 22


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, session_id, is_subagent, parent_session_id, line_no (from 1), value. Blank lines count, carriage returns stay.

    Files are read in blocks by many tasks, whatever their size. A first pass counts the lines of each block; the numbers
    of a block begin after those of the file's blocks before it. Should a later read deal blocks to tasks in another way,
    it fails rather than give wrong numbers.
    """
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(paths)
    raw = raw.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    # rows of a block stand one after the other in its task
    block = [F.xxhash64("path").alias("p"), "at", F.shiftright("id", 33).alias("task")]
    counts = raw.select(*block, "id").groupBy("p", "at", "task").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("p").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = counts.select("p", "at", "task", (before - F.col("first")).alias("shift")).collect()
    starts = spark.createDataFrame(rows, "p long, at long, task long, shift long")
    starts = F.broadcast(starts) if len(rows) <= BLOCKS else starts
    numbered = raw.select("value", "path", "id", *block).join(starts, ["p", "at", "task"], "left")
    number = F.coalesce("shift", F.raise_error(F.lit("the files' blocks changed since their lines were counted")).cast("long")) + F.col("id") + 1
    return numbered.select("path", *identity(F.col("path")), number.alias("line_no"), "value")


def identity(path: Column) -> list[Column]:
    """Whose transcript a path is: a session's own, or a subagent's below it."""
    stem = F.regexp_extract(path, r"([^/]+)\.jsonl$", 1)
    below = F.regexp_extract(path, r"/([^/]+)/subagents/", 1)
    return [F.regexp_replace(stem, "^agent-", "").alias("session_id"), (below != "").alias("is_subagent"), F.when(below != "", below).alias("parent_session_id")]


def records(lines: DataFrame) -> DataFrame:
    """Lines with their members under `r`; lines that are no JSON object are left out (skipped() counts them)."""
    parsed = lines.withColumn("r", F.from_json("value", RECORD)).filter(F.trim("value") != "")
    return parsed.filter(F.expr("try_parse_json(value) IS NOT NULL"))


def skipped(lines: DataFrame) -> DataFrame:
    """Malformed lines by session; blank ones are none."""
    bad = (F.trim("value") != "") & F.expr("try_parse_json(value) IS NULL")
    return lines.groupBy("session_id").agg(F.count(F.when(bad, 1)).alias("skipped_lines"))


def blocks(content: Column) -> Column:
    """Content is a text or an array of blocks: always as blocks."""
    listed = F.from_json(content, BLOCK)
    plain = F.array(F.struct(F.lit("text").alias("type"), content.alias("text")))
    as_text = F.transform(plain, lambda b: F.from_json(F.to_json(b), BLOCK.removeprefix("array<").removesuffix(">")))
    return F.when(content.isNull(), F.lit(None)).when(content.rlike(r"^\s*\[\s*(\{|\])"), listed).otherwise(as_text)


def flat_text(blocks: Column) -> Column:
    """The text blocks of a message, joined by newlines."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")


def spine(records: DataFrame) -> DataFrame:
    """The narrow columns that structure needs: no texts."""
    c = F.col("r.message.content")
    return records.select(
        "session_id", "line_no", F.col("r.type").alias("type"), F.col("r.uuid").alias("uuid"), F.col("r.parentUuid").alias("parent"), F.col("r.timestamp").alias("ts"), F.col("r.subtype").alias("subtype"),
        F.coalesce("r.isSidechain", F.lit(False)).alias("sidechain"), F.col("r.logicalParentUuid").alias("logical"), F.col("r.leafUuid").alias("leaf"), F.col("r.explicit").alias("explicit"), F.col("r.message.id").alias("message_id"),
        (c.contains('"tool_result"') & F.ltrim(c).startswith("[")).alias("carrier"),
    )
