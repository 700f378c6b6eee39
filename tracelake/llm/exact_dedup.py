"""Exact deduplication by two-pass Bloom filtering.

Pass one gives every text a hash and marks, in a bit array, which bits are set by one row and which by two or more.
A task sends only the places of the bits it sets, packed by segment of the array; a segment's task adds them up. The
array has a fixed number of bits, at most MAX_BITS (128 MiB), so what every worker holds of it has a bound. Pass two
looks every row up: a row with a bit that no other row sets is unique and passes straight through; only the others, of
which some are false alarms, shuffle to be compared exactly. More rows than the array was made for mean more false
alarms, never a wrong result: up to about 10^8 rows next to none, at 10^9 rows some 60 % of the unique ones.

Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D]; equality is that of SHA-256. Of
equal texts the row with the most code points stays, then the smallest doc_id (null ids last).

Defined results: null counts as an empty text, and empty texts are equal; rows that repeat the doc_id that stays, with
the same length, all count as it in groups() and become one row in keep(); an empty table gives an empty table; other
columns pass through keep() whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import held, open_fs, pack, plus, scratch, unpack, written

MIN_BITS, MAX_BITS, SEGMENT_BITS = 1 << 20, 1 << 30, 1 << 20
#: Bits of the array for each row, and bits that a row sets.
BITS_A_ROW, HASHES = 32, 4


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[ \t-\r]+", "")


def _places(sha: pa.Array, bits: int, hashes: int) -> np.ndarray:
    """The places that each hash sets, one row a hash: double hashing over two words of the SHA-256."""
    raw = np.frombuffer(b"".join(bytes.fromhex(s[:32]) for s in sha.to_pylist()), "<u8").reshape(-1, 2)
    step = raw[:, 1] | np.uint64(1)
    return (raw[:, :1] + step[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)


def repeated_bits(hashed: DataFrame, bits: int, path: str, hashes: int = HASHES) -> None:
    """Pass one: writes under path, segment by segment, which bits are set at least twice."""
    segments = bits // SEGMENT_BITS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            ends = np.searchsorted(at, np.arange(segments + 1, dtype=np.uint64) * np.uint64(SEGMENT_BITS))
            for s in np.flatnonzero(np.diff(ends)):
                a, b = ends[s], ends[s + 1]
                local = (at[a:b] - np.uint64(int(s) * SEGMENT_BITS)).astype("<u4")
                yield pa.RecordBatch.from_pydict({"segment": [int(s)], "at": [pack(np.diff(local, prepend=np.uint32(0)).astype("<u4"))], "twice": [np.packbits(n[a:b] > 1).tobytes()]})

        for batch in batches:
            if batch.num_rows:
                held.append(_places(batch["sha"], bits, hashes).reshape(-1))
            if sum(map(len, held)) > 4_000_000:
                yield from flush()
        if held:
            yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, at, more in zip(*(batch[c].to_pylist() for c in ("segment", "at", "twice")), strict=True):
                one = once.setdefault(s, np.zeros(SEGMENT_BITS, bool))
                two = twice.setdefault(s, np.zeros(SEGMENT_BITS, bool))
                local = np.cumsum(unpack(at, "<u4"), dtype=np.int64)
                two[local[one[local]]] = True
                two[local[np.unpackbits(np.frombuffer(more, np.uint8), count=len(local)).astype(bool)]] = True
                one[local] = True
        for s, two in twice.items():
            yield pa.RecordBatch.from_pydict({"segment": [s], "bits": [pack(np.packbits(two, bitorder="little"))]})

    dealt = hashed.select("sha").mapInArrow(place, "segment long, at binary, twice binary")
    n = max(1, min(segments, int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt.repartition(n, "segment").mapInArrow(add, "segment long, bits binary").write.parquet(path)


def _array(path: str, bits: int) -> np.ndarray:
    """The bit array, read by each worker from shared storage; segments without a repeated bit have no row."""

    def read() -> np.ndarray:
        import pyarrow.dataset as ds

        fs, base = open_fs(path)
        out = np.zeros(bits // 8, np.uint8)
        for batch in ds.dataset(base, filesystem=fs, format="parquet", exclude_invalid_files=False).to_batches():
            for s, packed in zip(batch["segment"].to_pylist(), batch["bits"].to_pylist(), strict=True):
                out[s * SEGMENT_BITS // 8 : (s + 1) * SEGMENT_BITS // 8] = unpack(packed, np.uint8)
        return out

    return held(("bits", path), read)


def maybe_repeated(hashed: DataFrame, bits: int, hashes: int = HASHES) -> DataFrame:
    """Both passes: adds the column maybe to rows with a column sha; false means that no other row has this sha."""
    path = scratch(hashed.sparkSession, "bloom")
    repeated_bits(hashed, bits, path, hashes)
    schema = plus(hashed.schema, maybe=T.BooleanType())

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = None
        for batch in batches:
            if not batch.num_rows:
                continue
            array = _array(path, bits) if array is None else array
            at = _places(batch["sha"], bits, hashes)
            hit = (array[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit.all(axis=1))], [*batch.schema.names, "maybe"])

    return hashed.mapInArrow(test, schema)


def array_bits(rows: int) -> int:
    """Bits of the array for so many rows: a power of two, within the bounds."""
    return min(MAX_BITS, max(MIN_BITS, 1 << max(0, rows * BITS_A_ROW - 1).bit_length()))


def hashes_for(rows: int, bits: int) -> int:
    """Bits that a row sets: fewer where the array is full, where each more means more false alarms."""
    return int(min(HASHES, max(1, round(0.69 * bits / max(1, rows)))))


def _winners(rows: DataFrame) -> DataFrame:
    """For each sha: keep_len, keep_id and group_size. Sums are taken before anything shuffles."""
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id")))
    return rows.groupBy("sha").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select("sha", F.col("best.id").alias("keep_id"), (-F.col("best.n")).alias("keep_len"), "group_size")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. No text shuffles."""
    hashed = docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("sha"), F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)).alias("n_chars"))
    hashed = written(hashed, "hashes")
    rows = hashed.count()
    size = bits or array_bits(rows)
    tested = written(maybe_repeated(hashed, size, hashes_for(rows, size)), "tested")
    alone = tested.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    some = tested.filter("maybe")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_len"))
    # written, so that both sides of the join are plain exchanges, which Spark can split where a group is large
    rest = some.join(written(_winners(some), "winners"), "sha").select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(rest)


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """The rows of docs that stay, with their columns. Texts of rows that may be repeated shuffle, no others."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    hashed = docs.select(row.alias("row"), F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("sha"), F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)).alias("n_chars"), F.col(id_col).alias("doc_id"))
    narrow = written(hashed.select("sha"), "hashes")
    rows = narrow.count()
    size = bits or array_bits(rows)
    hashes = hashes_for(rows, size)
    path = scratch(docs.sparkSession, "bloom")
    repeated_bits(narrow, size, path, hashes)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = _places(batch["sha"], size, hashes)
                array = _array(path, size)
                hit = (array[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit.all(axis=1))], [*batch.schema.names, "maybe"])

    tested = hashed.mapInArrow(test, plus(hashed.schema, maybe=T.BooleanType()))
    some = tested.filter("maybe")
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_len"))
    # Both sides of the join are plain exchanges, which Spark can split where a group is large. One row of each group is
    # left after it; rows that repeat its id become one.
    winners = written(_winners(some.select("sha", "n_chars", "doc_id")), "winners")
    rest = written(some.join(winners, "sha").filter(same), "kept").dropDuplicates(["sha"])
    return tested.filter(~F.col("maybe")).select("row.*").unionByName(rest.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: groups of equal texts among all documents."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s, length(coalesce(text, '')) AS l
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY s ORDER BY l DESC, doc_id NULLS LAST) AS keep_id,
    count(*) OVER (PARTITION BY s) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, s AS text_sha256 FROM k
"""
