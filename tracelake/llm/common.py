"""Helpers shared by the training-data operators: shared storage, blocks of rows, packed arrays."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one block of rows holds at about; a longer text is a block of its own.
BLOCK_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir; a local one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file:///tmp/checkpoints/tracelake"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: it cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like written(), dealt into buckets by key, so that a later join on key moves only the other side."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", scratch(spark, name)).bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI in shared storage (file, s3, gs, hdfs)."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def pack(a: np.ndarray) -> bytes:
    """A compressed array: its bytes are laid out in planes, which compress better."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T if len(a) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b, max_output_size=1 << 31), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype) if len(raw) else np.zeros(0, dtype)


def pack_strings(a: pa.Array) -> bytes:
    """An Arrow array in compressed IPC form."""
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([a], ["v"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_strings(b: bytes) -> pa.Array:
    with pa.ipc.open_stream(b) as r:
        return r.read_all().column(0).combine_chunks()


def release() -> None:
    """Give freed memory back to the system: workers live on, and what they keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


_HELD: dict[tuple, object] = {}


def held(key: tuple, build: Callable[[], object]):
    """What key names, built once by each worker. Workers live on through a job's stages, so one holds one such thing (a
    model, a table, a tokenizer) at a time: what an earlier stage needed goes first."""
    if key not in _HELD:
        _HELD.clear()
        release()
        _HELD[key] = build()
        release()
    return _HELD[key]


def text_blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Regroup a task's batches into blocks of about `limit` bytes of text; null texts become empty ones."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.schema.get_field_index(text)
        col = pc.fill_null(batch.column(k).cast(pa.string()), "")
        batch = batch.set_column(k, text, col)
        ends = np.cumsum(np.asarray(pc.binary_length(col), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit - size, side="right")))
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1]) - before
            at = to
            if size >= limit or at < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
                release()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    release()


#: Words of all blocks in a range of word hashes at about, and most ranges (a block has a row for each range of its words).
RANGE_WORDS, RANGES = 1_000_000, 4096


def ranges_for(blocks: DataFrame, count: str = "n_distinct") -> int:
    """Ranges of word hashes for blocks whose column `count` says how many distinct words each has: no fewer than there
    are shuffle partitions, and with more words more ranges, so that a task holds the words of one range at a time."""
    words = blocks.agg(F.sum(count)).first()[0] or 0
    return max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(RANGES, -(-words // RANGE_WORDS)))


def ranges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[dict]]:
    """The rows of each range, one range after the other, of batches sorted by their column range. Each has to be used up."""
    rows = ({name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)} for batch in batches for k in range(batch.num_rows))
    return (own for _, own in groupby(rows, key=itemgetter("range")))


def one_chunk(col: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        return col.chunk(0) if col.num_chunks == 1 else pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    return col


def list_parts(a: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0 and the flat values of a list array without nulls."""
    off = np.asarray(a.offsets, dtype=np.int64)
    return off - off[0], a.flatten()


def string_parts(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and the bytes of a string or binary array without nulls."""
    a = a.cast(pa.large_binary())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return off - off[0], data


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (two multiply-xorshift rounds)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def hash_strings(a: pa.Array) -> np.ndarray:
    """A 64-bit polynomial hash of each string. For dealing out rows and for finding candidates, never for equality."""
    off, data = string_parts(a)
    n = np.diff(off)
    if not len(n):
        return np.zeros(0, np.uint64)
    longest = int(n.max()) if len(n) else 0
    powers = np.cumprod(np.full(longest + 1, 0x9E3779B97F4A7C15, np.uint64))
    pos = np.arange(len(data)) - np.repeat(off[:-1], n)
    v = np.append((data.astype(np.uint64) + np.uint64(1)) * powers[pos], np.uint64(0))
    h = np.add.reduceat(v, np.minimum(off[:-1], len(data)))
    h[n == 0] = 0
    return mix64(h + n.astype(np.uint64))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i]+lens[i]-1, one run after the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 30 and (not len(starts) or starts.max() < 1 << 30) else np.int64
    out = np.repeat((starts - (ends - lens)).astype(kind), lens)
    out += np.arange(total, dtype=kind)
    return out


def plus(schema: T.StructType, **fields: T.DataType) -> T.StructType:
    """A schema with further fields; the given one stays as it is."""
    return T.StructType([*schema.fields, *(T.StructField(k, v) for k, v in fields.items())])
