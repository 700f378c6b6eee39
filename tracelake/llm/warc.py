"""WARC archives compressed with Zstandard: one frame for each record, after a skippable frame with the dictionary.

Writing: equal payloads are found by SHA-1 before anything is written; the row with the smallest page_id becomes the
response, the others become revisits that keep the response's HTTP header (its Content-Length is the full payload's
length) and refer to its record. Each task writes files of its own in shared storage, named in a manifest that Spark's
own writer commits: files of a task that failed or ran twice aren't named and aren't read.

Reading: the dictionary is loaded from the leading skippable frame (magic 0x184D2A5D; the dictionary may itself be a
Zstandard frame), each further frame is decoded as one record, and version, headers, lengths, block and payload digests
and the record's end are checked. A record that fails has an error and no payload; a file that breaks off gives what
comes before the break, and an error.

A record's id names the page and its payload's digest, so that rows with one page_id and different payloads have records
of different ids; rows that repeat whole have one id.

Defined results: a null html is an empty payload; a null url becomes urn:x-page:<page_id>; a null page_id is written as
null and read back so, and counts as larger than all others; rows that repeat the
response's page_id and payload are responses too; payloads under `least` bytes are all responses; an empty table gives no file;
other columns are ignored whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import open_fs, scratch, written

#: Fixed values of the formats.
SKIPPABLE, ZSTD_MAGIC, VERSION = 0x184D2A5D, b"\x28\xb5\x2f\xfd", b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payload in one file at about; bytes of the dictionary and of the payloads that it is made from.
FILE_BYTES, DICT_BYTES, SAMPLE_BYTES = 64 << 20, 16 << 10, 1 << 20


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header_value(v: str) -> str:
    """A value that stays on its line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", v)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = "null" if page_id is None else page_id
    digest = digest32(payload)
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:x-page:{name}:{digest}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _header_value(url if url is not None else f"urn:x-page:{name}")),
        ("WARC-Payload-Digest", "sha1:" + digest),
        ("WARC-Block-Digest", "sha1:" + digest32(block)),
    ]
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:x-page:{'null' if refers_to is None else refers_to}:{digest}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from a bounded sample of payloads; none if they are too few to make one."""
    held, size = [], 0
    for s in samples:
        if size >= SAMPLE_BYTES:
            break
        held.append(s[: 64 << 10])
        size += len(held[-1])
    try:
        return zstandard.train_dictionary(DICT_BYTES, [s for s in held if len(s) >= 8]).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive(records: list[bytes], samples: list[bytes]) -> Iterator[bytes]:
    """An archive's parts: the dictionary's frame and a frame for each record."""
    raw = dictionary(samples)
    shared = zstandard.ZstdCompressionDict(raw) if raw else None
    body = zstandard.ZstdCompressor(level=3).compress(raw) if raw else b""
    yield struct.pack("<II", SKIPPABLE, len(body)) + body
    c = zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=True, write_content_size=True)
    for r in records:
        yield c.compress(r)


class Broken(ValueError):
    """What is wrong with a record or file."""


def load_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary in the leading skippable frame, and where the records' frames begin."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != SKIPPABLE:
        return None, 0
    (size,) = struct.unpack_from("<I", data, 4)
    if len(data) < 8 + size:
        raise Broken("the dictionary's frame breaks off")
    body = bytes(data[8 : 8 + size])
    if body.startswith(ZSTD_MAGIC):
        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    return (zstandard.ZstdCompressionDict(body) if body else None), 8 + size


def frames(data: memoryview) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, one frame decoded, what is wrong) for each frame after the dictionary."""
    try:
        shared, at = load_dictionary(data)
    except (Broken, zstandard.ZstdError) as e:
        yield 0, None, str(e)
        return
    d = zstandard.ZstdDecompressor(dict_data=shared)
    while at < len(data):
        try:
            if len(data) - at >= 8 and struct.unpack_from("<I", data, at)[0] & 0xFFFFFFF0 == 0x184D2A50:
                at += 8 + struct.unpack_from("<I", data, at + 4)[0]
                continue
            one = d.decompressobj()
            # the object stops at the frame's end; it is fed in steps, so that a step past the end is short
            out, to = [], at
            while not one.eof:
                if to >= len(data):
                    raise Broken("the frame breaks off")
                step = bytes(data[to : to + 16384])
                out.append(one.decompress(step))
                to += len(step)
            to -= len(one.unused_data)
            yield at, b"".join(out), None
            at = to
        except (Broken, zstandard.ZstdError) as e:
            yield at, None, f"frame: {e}"
            return


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; raises Broken."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise Broken("the header has no end")
    # a line that begins with white space goes on with the one before it
    lines = re.sub(rb"\r\n[ \t]+", b" ", raw[:end]).split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise Broken("not a WARC record")
    head: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!-9;-~]+", name):
            raise Broken("a header line has no name")
        head[name.decode().lower()] = value.strip().decode(errors="replace")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in head:
            raise Broken(f"{name} is missing")
    if not head["content-length"].isdigit():
        raise Broken("content-length is no number")
    size = int(head["content-length"])
    if len(raw) != end + 4 + size + 4 or raw[-4:] != b"\r\n\r\n":
        raise Broken(f"the block has {len(raw) - end - 8} bytes, its header says {size}")
    block = raw[end + 4 : end + 4 + size]
    if (want := head.get("warc-block-digest")) and want != "sha1:" + digest32(block):
        raise Broken("the block's digest differs")
    return head, block


def parse_page(raw: bytes) -> dict:
    """Columns of one record that write_pages() wrote; raises Broken."""
    head, block = parse(raw)

    def number(urn: str) -> int | None:
        found = re.fullmatch(r"<urn:x-page:(null|-?\d+):[A-Z2-7]{32}>", urn)
        if not found:
            raise Broken("the id is no page's")
        return None if found[1] == "null" else int(found[1])

    http, _, body = block.partition(b"\r\n\r\n")
    found = re.search(rb"(?im)^content-length: *(\d+)\r?$", http)
    if not found:
        raise Broken("the HTTP header has no length")
    size, kind = int(found[1]), head["warc-type"]
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (len(body) != size or digest32(body) != digest):
        raise Broken("the payload differs from its length or digest")
    if kind == "revisit" and (body or "warc-refers-to" not in head):
        raise Broken("the revisit has a payload or refers to nothing")
    return {
        "page_id": number(head["warc-record-id"]), "url": head.get("warc-target-uri"), "record_type": kind, "payload_bytes": size, "payload_digest": digest,
        "refers_to": number(head["warc-refers-to"]) if kind == "revisit" else None, "payload": body if kind == "response" else None,
    }


def write_pages(pages: DataFrame, path: str, least: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html); returns the manifest (file, n_records)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    # Written, so that both sides of the join are plain exchanges, which Spark can split where a payload is frequent.
    first = written(rows.select("sha", "page_id").groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")), "payloads")
    dealt = rows.join(first, "sha").select("page_id", "url", "payload", "sha", "first", ((F.col("n") > 1) & (F.length("payload") >= least)).alias("shared"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(path)
        part, held, samples, size, seq = TaskContext.get().partitionId(), [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal size, seq
            fs.create_dir(base, recursive=True)
            name = f"pages-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                for piece in archive(held, samples):
                    out.write(piece)
            row = pa.RecordBatch.from_pydict({"file": [name], "n_records": [len(held)]})
            held.clear(), samples.clear()
            size, seq = 0, seq + 1
            return row

        for batch in batches:
            for r in batch.to_pylist():
                revisit = r["shared"] and not r["here"]
                held.append(record(r["page_id"], r["url"], r["payload"], r["first"], revisit, date))
                if not revisit:
                    samples.append(r["payload"]) if size < 4 * SAMPLE_BYTES else None
                size += len(held[-1])
                if size >= file_bytes:
                    yield flush()
        if held:
            yield flush()

    marked = dealt.withColumn("here", F.col("page_id").eqNullSafe(F.col("first")))
    marked.mapInArrow(write, "file string, n_records long").write.parquet(f"{path}/manifest")
    return pages.sparkSession.read.parquet(f"{path}/manifest")


READ = "file string, at long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"


def read_pages(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives that the manifest under path names; error says what is wrong with one."""
    files = spark.read.parquet(f"{path}/manifest").select("file")
    n = max(1, files.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(path)
        names = [f.split()[0] for f in READ.split(", ")]
        empty = dict.fromkeys(names)
        kinds = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in READ.split(", ")])
        for batch in batches:
            for file in batch["file"].to_pylist():
                with fs.open_input_file(f"{base}/{file}") as f:
                    data = memoryview(f.read_buffer())
                rows, size = [], 0
                for at, raw, wrong in frames(data):
                    row = empty | {"file": file, "at": at, "error": wrong}
                    if raw is not None:
                        try:
                            row |= parse_page(raw)
                        except Broken as e:
                            row["error"] = str(e)
                        if not payloads:
                            row["payload"] = None
                        size += len(row["payload"] or b"")
                    rows.append(row)
                    if len(rows) >= 2000 or size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    return files.repartition(n, "file").mapInArrow(read, READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all pages, written as archives and read back."""
    path = scratch(spark, "warc")
    write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    got = read_pages(spark, path, payloads=False)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
