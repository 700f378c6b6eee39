"""Images in transcripts: listing with handles, distinct images, bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The formats that images are written in.
FORMATS = {"image/png": "png", "image/jpeg": "jpg", "image/jpg": "jpg", "image/gif": "gif", "image/webp": "webp"}


def markers(text: Column) -> Column:
    """Numbers of [Image #N] in a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit("\\[Image #([0-9]+)\\]"), F.lit(1)), lambda n: n.try_cast("long"))


def decoded_size(data: Column) -> Column:
    """Bytes of base64 data, without decoding it; white space doesn't count."""
    b = F.regexp_replace(data, r"\s", "")
    return F.floor(F.length(b) * 3 / 4).cast("long") - (F.length(b) - F.length(F.rtrim(b, F.lit("=")))).cast("long")


def listing(labelled: DataFrame) -> DataFrame:
    """session_id, line_no, at (0 first), handle (by the text's markers, else null), media_type, format, size, fingerprint."""
    shown = F.filter("blocks", lambda b: (b["type"] == "image") & (b["source"]["type"] == "base64") & b["source"]["data"].isNotNull())
    rows = labelled.filter(F.col("value").contains('"image"')).select("session_id", "line_no", markers(F.col("text")).alias("numbers"), F.posexplode(shown).alias("at", "b"))
    table = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return rows.select("session_id", "line_no", "at", F.get("numbers", F.col("at")).alias("handle"), F.col("b.source.media_type").alias("media_type"), F.element_at(table, F.col("b.source.media_type")).alias("format"), decoded_size(F.col("b.source.data")).alias("size"), F.sha2(F.regexp_replace("b.source.data", r"\s", ""), 256).alias("fingerprint"))


def latest(images: DataFrame) -> DataFrame:
    """Of equal images of a session the last, with the number of them."""
    columns = [c for c in images.columns if c not in ("session_id", "fingerprint")]
    once = images.groupBy("session_id", "fingerprint").agg(F.max_by(F.struct(*columns), F.struct("line_no", "at")).alias("r"), F.count(F.lit(1)).alias("shown"))
    return once.select("session_id", "fingerprint", "r.*", "shown")


def contents(labelled: DataFrame) -> DataFrame:
    """session_id, line_no, at, content (binary; null where the data isn't base64)."""
    shown = F.filter("blocks", lambda b: b["type"] == "image")
    data = F.try_to_binary(F.regexp_replace("b.source.data", r"\s", ""), F.lit("base64"))
    return labelled.filter(F.col("value").contains('"image"')).select("session_id", "line_no", F.posexplode(shown).alias("at", "b")).select("session_id", "line_no", "at", data.alias("content"))
