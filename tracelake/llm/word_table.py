"""BPE through a distinct-word table: split in Spark, encode each distinct word once, join the ids back by position.

1. Every task cuts its texts into blocks. A block keeps, for each document, which unit stands at each place, and the
   block's own distinct words. Blocks are written once, dealt into buckets by block.
2. Words are dealt by hash; the task that gets a word encodes it once, however many blocks hold it, and sends each
   block the ids of its words. What moves is a row for each block and range of hashes, with all its words packed: it
   grows with the blocks' distinct words, not with the tokens, and a word that is everywhere weighs as one row a block.
3. Blocks join their words' ids, and the ids are put in place by position.

Decoding joins ids with the pieces of the vocabulary by id. That table has a fixed size (the vocabulary's), so each
worker holds it whole.

Defined results: a null text is an empty one; an empty text has no ids and decodes to an empty text; repeated rows and
null ids each give their row; an empty table gives no row; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.codec import Codec, byte_letters, codec
from tracelake.llm.common import bucketed, hash_strings, one_chunk, pack, pack_strings, ragged, ranges_for, ranges_of, release, text_blocks, unpack, unpack_strings

#: Words that a task's table holds at most.
TABLE_WORDS = 1_000_000
BLOCKS = "block long, doc_ids binary, n_units binary, units binary, unit_sizes binary, unit_words binary, words binary, n_distinct long"


def word_blocks(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents: the units of each document by position, the words of each unit, the block's distinct words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer)
        part = TaskContext.get().partitionId()
        for k, block in enumerate(text_blocks(batches)):
            off, units, names, own = code.units(one_chunk(block["text"]))
            place: dict[str, int] = {}
            sizes, flat = np.zeros(len(names), np.int64), []
            for u, (name, words) in enumerate(zip(names, own, strict=True)):
                words = code.split(name) if words is None else words
                sizes[u] = len(words)
                flat += [place.setdefault(w, len(place)) for w in words]
            row = {
                "block": [(part << 20) + k],
                "doc_ids": [pack_strings(one_chunk(block["doc_id"]))],
                "n_units": [pack(np.diff(off).astype("<u4"))],
                "units": [pack(units.astype("<u4"))],
                "unit_sizes": [pack(sizes.astype("<u4"))],
                "unit_words": [pack(np.array(flat, "<u4"))],
                "words": [pack_strings(pa.array(list(place), pa.string()))],
                "n_distinct": [len(place)],
            }
            yield pa.RecordBatch.from_pydict(row)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(cut, BLOCKS)


def deal_words(blocks: DataFrame, ranges: int) -> DataFrame:
    """A row for each block and range of word hashes: range, block, at (places in the block's table), words."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch["block"].to_pylist(), batch["words"], strict=True):
                words = unpack_strings(packed.as_py())
                to = (hash_strings(words) % np.uint64(ranges)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                ends = np.searchsorted(to[order], np.arange(ranges + 1))
                for r in np.flatnonzero(np.diff(ends)):
                    at = order[ends[r] : ends[r + 1]]
                    yield pa.RecordBatch.from_pydict({"range": [int(r)], "block": [block], "at": [pack(at.astype("<u4"))], "words": [pack_strings(words.take(pa.array(at)))]})

    return blocks.select("block", "words").mapInArrow(deal, "range long, block long, at binary, words binary")


def encode_words(dealt: DataFrame, tokenizer: str) -> DataFrame:
    """The distinct-word table at work: a word is encoded where its hash is dealt to, once; each block gets its ids.

    Past TABLE_WORDS distinct words of one range the table is begun anew, and words that come again are encoded again."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer)
        for rows in ranges_of(batches):
            table: dict[str, bytes] = {}
            for row in rows:
                got = []
                for w in unpack_strings(row["words"]).to_pylist():
                    ids = table.get(w)
                    if ids is None:
                        if len(table) >= TABLE_WORDS:
                            table.clear()
                        ids = table[w] = np.array(code.word_ids(w), code.dtype).tobytes()
                    got.append(ids)
                size = np.fromiter(map(len, got), np.int64, len(got)) // code.dtype.itemsize
                yield pa.RecordBatch.from_pydict({"block": [row["block"]], "at": [row["at"]], "sizes": [pack(size.astype("<u4"))], "ids": [pack(np.frombuffer(b"".join(got), code.dtype))]})
            del table
            release()

    # a task takes its ranges one after the other
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "range").sortWithinPartitions("range").mapInArrow(encode, "block long, at binary, sizes binary, ids binary")


def _placed(row: dict, parts: list[dict], code: Codec) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """doc_ids, number of ids of each document, and all ids, of one block."""
    n_words = sum(len(unpack(p["sizes"], "<u4")) for p in parts)
    size, begin = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
    pools, upto = [], 0
    for p in parts:
        at, own, ids = unpack(p["at"], "<u4"), unpack(p["sizes"], "<u4").astype(np.int64), unpack(p["ids"], code.dtype)
        size[at], begin[at] = own, upto + np.cumsum(own) - own
        pools.append(ids)
        upto += len(ids)
    pool = np.concatenate(pools) if pools else np.zeros(0, code.dtype)
    # ids of each unit, in a row
    unit_sizes, unit_words = unpack(row["unit_sizes"], "<u4").astype(np.int64), unpack(row["unit_words"], "<u4")
    by_unit = pool[ragged(begin[unit_words], size[unit_words])]
    upto_word = np.concatenate([[0], np.cumsum(size[unit_words])])
    unit_ends = upto_word[np.cumsum(unit_sizes)] if len(unit_sizes) else np.zeros(0, np.int64)
    unit_lens = np.diff(np.concatenate([[0], unit_ends]))
    units = unpack(row["units"], "<u4")
    ids = by_unit[ragged((unit_ends - unit_lens)[units], unit_lens[units])]
    upto_unit = np.concatenate([[0], np.cumsum(unit_lens[units])])
    doc_ends = np.concatenate([[0], np.cumsum(unpack(row["n_units"], "<u4").astype(np.int64))])
    return unpack_strings(row["doc_ids"]), np.diff(upto_unit[doc_ends]), ids


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks with all that _placed() needs, one row a block: the word table's ids joined back."""
    spark = docs.sparkSession
    blocks = bucketed(word_blocks(docs, tokenizer, id_col, text_col), "word_blocks", "block", int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = encode_words(deal_words(blocks, ranges_for(blocks)), tokenizer)
    parts = ids.groupBy("block").agg(F.collect_list(F.struct("at", "sizes", "ids")).alias("parts"))
    return blocks.drop("words", "n_distinct").join(parts, "block", "left")


def pieces(code: Codec) -> pa.Array:
    """The bytes of each id of the vocabulary, by id; ids without a token are empty."""
    back = {c: b for b, c in byte_letters().items()}
    special = {i: c for c, i in code.special.items()}
    out = []
    for i in range(max(code.vocab, 1 + max(special, default=0))):
        token = code.tok.id_to_token(i) or ""
        out.append(token.encode() if i in special or any(c not in back for c in token) else bytes(back[c] for c in token))
    return pa.array(out, pa.large_binary())


def decode_all(ids: np.ndarray, bounds: np.ndarray, code: Codec) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins and ends, and the bytes of all texts: through the pieces if ids stand for bytes, else the library."""
    if code.kind == "byte":
        off, data = joined(ids, tables_of(code)[0])
        return off[bounds], data
    texts = [code.tok.decode(ids[a:b].tolist(), skip_special_tokens=False).encode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]), np.frombuffer(b"".join(texts), np.uint8)


def joined(ids: np.ndarray, table: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Join ids with a table by id: where each id's bytes begin and end, and all the bytes in one array."""
    got = table.take(pa.array(ids.astype(np.int32)))
    off = np.frombuffer(got.buffers()[1], np.int64)[: len(got) + 1] if len(got) else np.zeros(1, np.int64)
    return off, np.frombuffer(got.buffers()[2] or b"", np.uint8)


def tables_of(code: Codec) -> tuple[pa.Array, pa.Array]:
    """Pieces by id, and decimal digits with a comma by id."""
    if code.tables is None:
        p = pieces(code)
        code.tables = p, pa.array([b"%d," % i for i in range(len(p))], pa.large_binary())
    return code.tables


def _documents(batches: Iterator[pa.RecordBatch], code: Codec) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
            yield _placed(row, row["parts"] or [], code)
            release()


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int): each document encoded."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, n, ids in _documents(batches, codec(tokenizer)):
            off = np.concatenate([[0], np.cumsum(n)])
            for at in range(0, len(n), 1000):
                to = min(at + 1000, len(n))
                values = pa.array(ids[off[at] : off[to]].astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array((off[at : to + 1] - off[at]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([doc_ids[at:to], lists], ["doc_id", "ids"])

    return encode(docs, tokenizer, id_col, text_col).mapInArrow(out, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text: ids (array of int) decoded, special tokens included."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer)
        for batch in batches:
            lists = batch["ids"]
            off = np.asarray(lists.offsets, np.int64)
            cut, data = decode_all(np.asarray(lists.flatten()), off - off[0], code)
            texts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.mapInArrow(out, "doc_id long, text string")


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, decoded again through the pieces, and hashed."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer)
        digits = tables_of(code)[1]
        for doc_ids, n, ids in _documents(batches, code):
            ends = np.cumsum(n)
            shas: list[list[str]] = [[], []]
            # as many documents at a time as have about a million ids
            at = 0
            while at < len(n):
                first = int(ends[at] - n[at])
                to = max(at + 1, int(np.searchsorted(ends, first + (1 << 20), side="right")))
                part, bounds = ids[first : int(ends[to - 1])], np.concatenate([[0], ends[at:to] - first])
                off, data = joined(part, digits)
                for k, (cut, data) in enumerate(((off[bounds], data), decode_all(part, bounds, code))):
                    view, cut = memoryview(data), cut.tolist()
                    # the digits of a document end with a comma too many
                    shas[k] += [hashlib.sha256(view[a : b - (k == 0 and b > a)]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                at = to
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(n, pa.int64()), pa.array(shas[0], pa.string()), pa.array(shas[1], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(docs, tokenizer, id_col, text_col).mapInArrow(out, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents encoded and decoded."""
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
