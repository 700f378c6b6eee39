"""Token-id files: Elias-Fano coded document boundaries over one array of ids.

A file is  magic | header length (u32) | header (JSON) | sections.  The ids of all its documents stand one after the
other in the narrowest unsigned type that holds the vocabulary. Where each document ends, and which doc_id it has, is
kept in Elias-Fano form: low bits packed, high bits in unary, and the place of every 64th one in 32 bits, so that
select(i) finds an offset with one sample and a few population counts and no table of 64-bit offsets exists.

Files are written by executors in shared storage; only files named in the manifest, which Spark's own writer commits,
count, so that a task that ran twice leaves nothing behind that is read.

Defined results: a null text is an empty one; an empty text has just the end id; rows with a null doc_id come first;
rows with the same doc_id all stand, in the order of their texts' hashes; an empty table gives no file; other columns
are ignored whatever their names.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.codec import codec
from tracelake.llm.common import one_chunk, open_fs, scratch, text_blocks

MAGIC = b"TLIDSEF1"
#: Ids in one file at about; a file ends with the block that reaches it.
FILE_IDS = 32 << 20
#: One sample for so many ones of the high bits.
STEP = 64


class EliasFano:
    """A non-decreasing sequence of integers from 0 to universe."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples
        self._words: np.ndarray | None = None

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        universe = int(values[-1]) if n else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        ones = (values >> low_bits) + np.arange(n)
        bits = np.zeros((-(-(int(ones[-1]) + 1 if n else 0) // 64)) * 64, np.uint8)
        bits[ones] = 1
        low = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).reshape(-1)
        return cls(n, low_bits, np.packbits(low, bitorder="little"), np.packbits(bits, bitorder="little"), ones[::STEP].astype("<u4"))

    def sections(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        got = int.from_bytes(self.low[at >> 3 : (at + self.low_bits + 7) >> 3].tobytes(), "little")
        return (got >> (at & 7)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value i: one sample, then whole words by population count, then bits of one word."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        if self._words is None:
            self._words = self.high.view("<u8")
        at, left = int(self.samples[i // STEP]), i % STEP
        k = at >> 6
        word = int(self._words[k]) & ~((1 << (at & 63)) - 1)
        while (c := word.bit_count()) <= left:
            left -= c
            k += 1
            word = int(self._words[k])
        for _ in range(left):
            word &= word - 1
        one = (k << 6) + ((word & -word).bit_length() - 1)
        return ((one - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        """All values, in one pass."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return ((ones - np.arange(self.n)) << self.low_bits) | low


class IdFile:
    """A file of ids, open for reading."""

    def __init__(self, data: bytes | memoryview):
        data = memoryview(data)
        if bytes(data[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a token-id file")
        (size,) = struct.unpack_from("<I", data, len(MAGIC))
        at = len(MAGIC) + 4
        self.header = json.loads(bytes(data[at : at + size]))
        at += size
        got = []
        for length in self.header["sections"]:
            got.append(np.frombuffer(data[at : at + length], np.uint8))
            at += length
        if at != len(data):
            raise ValueError(f"the file has {len(data)} bytes, its header says {at}")
        h = self.header
        self.ends = EliasFano(h["docs"], h["end_bits"], got[0], got[1], got[2].view("<u4"))
        self.doc_ids = EliasFano(h["docs"] - h["null_ids"], h["doc_bits"], got[3], got[4], got[5].view("<u4"))
        self.ids = got[6].view(f"<u{h['width']}")

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def doc_id(self, i: int) -> int | None:
        k = self.header["null_ids"]
        return None if i < k else self.doc_ids.select(i - k) + self.header["doc_base"]

    def document(self, i: int) -> np.ndarray:
        lo, hi = self.bounds(i)
        return self.ids[lo:hi]


def file_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's bytes; documents in ascending doc_id order, null ones first."""
    nulls = sum(d is None for d in doc_ids)
    own = np.array(doc_ids[nulls:], np.int64)
    base = int(own[0]) if len(own) else 0
    ends, docs = EliasFano.build(np.cumsum(counts)), EliasFano.build(own - base)
    parts = [*ends.sections(), *docs.sections(), ids.tobytes()]
    header = {"docs": len(doc_ids), "ids": len(ids), "width": ids.dtype.itemsize, "null_ids": nulls, "doc_base": base, "end_bits": ends.low_bits, "doc_bits": docs.low_bits, "sections": [len(p) for p in parts]}
    head = json.dumps(header).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts])


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode documents and write files of ids under path; returns the manifest (part, seq, file, n_docs, n_ids).

    One shuffle puts the texts in order of doc_id; encoding and writing follow in the same stage.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = narrow.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer)
        fs, base = open_fs(path)
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq
            fs.create_dir(base, recursive=True)
            name = f"ids-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.bin"
            all_counts, all_ids = np.concatenate(counts), np.concatenate(ids)
            with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(file_bytes(doc_ids, all_counts, all_ids))
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": [name], "n_docs": [len(doc_ids)], "n_ids": [len(all_ids)]})
            seq += 1
            doc_ids.clear(), counts.clear(), ids.clear()
            return row

        for block in text_blocks(batches):
            n_ids, got = code.encode(one_chunk(block["text"]))
            ends = np.cumsum(n_ids + 1)
            full = np.full(int(ends[-1]), end_id, code.dtype)
            keep = np.ones(len(full), bool)
            keep[ends - 1] = False
            full[keep] = got
            doc_ids += block["doc_id"].to_pylist()
            counts.append(n_ids + 1)
            ids.append(full)
            if sum(map(len, ids)) >= file_ids:
                yield flush()
        if doc_ids:
            yield flush()

    manifest = ordered.mapInArrow(write, "part long, seq long, file string, n_docs long, n_ids long")
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Documents of all files under path: doc_id, start (ids before it in all files), n_tokens, ids_crc32.

    The manifest has a row for each file, so the driver can add up where each file starts.
    """
    rows = sorted(spark.read.parquet(f"{path}/manifest").collect(), key=lambda r: (r.part, r.seq))
    start, files = 0, []
    for r in rows:
        files.append((r.file, start))
        start += r.n_ids
    listed = spark.createDataFrame(files, "file string, first long").repartition(max(1, len(files)), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(path)
        for batch in batches:
            for file, first in zip(batch["file"].to_pylist(), batch["first"].to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{file}") as f:
                    got = IdFile(f.read_buffer())
                ends = got.ends.all()
                begin = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(got.ids[a:b].astype("<u4").tobytes()) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                ids = [None] * got.header["null_ids"] + (got.doc_ids.all() + got.header["doc_base"]).tolist()
                for at in range(0, len(ids), 10_000):
                    to = at + 10_000
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at:to], pa.int64()), pa.array(begin[at:to] + first), pa.array(ends[at:to] - begin[at:to]), pa.array(crc[at:to], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all documents, written as id files and read back."""
    import public_tokenizers

    path = scratch(spark, "token-ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_ids(spark, path)
