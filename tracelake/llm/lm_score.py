"""Scores of a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

1. Documents become blocks (their own distinct words, and which word stands at each place), written once.
2. Words are dealt by hash; the task that gets a word adds up its count in all training documents and sends it to every
   block that holds the word. Counts cover all training documents, the table of words is never in one place.
3. The model's symbols are the TOP most frequent words, the end of text, and classes of all other words by their last
   two letters. Counts of symbol triples over all training documents are summed by Spark; there are at most SYMBOLS^3.
   They are sufficient for the model: it is trained on the driver from them.
4. The model is  s(w | a, b) = (A r[a] + B r[b]) . q[w] + bias[w]  with two words of context, trained to tell the
   corpus from noise drawn by unigram counts. For scoring, one batched matrix product over the contexts of a block gives
   the normalising sums. A word outside the TOP has its class's probability times its share of the class, with one
   count more for each word and for a word never seen, so that the probabilities of all tokens sum to one.

Defined results: a null text is an empty one (its only token is the end); a null doc_id belongs to the training part;
repeated rows each give their row; with no training document every count is zero; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import bucketed, hash_strings, list_parts, one_chunk, pack, pack_strings, ranges_for, ranges_of, release, text_blocks, unpack, unpack_strings, written

TOP, CLASSES = 192, 61
#: Symbols: words, classes (the last one for endings that are no class of their own), start, end.
START, END = TOP + CLASSES, TOP + CLASSES + 1
SYMBOLS = TOP + CLASSES + 2
DIM, NOISE, EPOCHS, RATE = 24, 8, 40, 0.2


def blocks_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks: document ids, held-out flags, tokens by position, distinct words, their counts in training documents."""
    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, block in enumerate(text_blocks(batches)):
            off, flat = list_parts(pc.ascii_split_whitespace(pc.ascii_lower(one_chunk(block["text"]))))
            # leading and trailing white space leaves empty strings
            full = np.asarray(pc.not_equal(flat, ""))
            if not full.all():
                off = np.concatenate([[0], np.cumsum(full)])[off]
                flat = flat.filter(pa.array(full))
            enc = flat.dictionary_encode()
            at = np.asarray(enc.indices).astype(np.int64)
            held = np.asarray(one_chunk(block["held_out"]))
            train = np.repeat(~held, np.diff(off))
            counts = np.bincount(at[train], minlength=len(enc.dictionary))
            yield pa.RecordBatch.from_pydict({
                "block": [(part << 20) + k],
                "doc_ids": [pack_strings(one_chunk(block["doc_id"]))],
                "held": [np.packbits(held).tobytes()],
                "n_words": [pack(np.diff(off).astype("<u4"))],
                "at": [pack(at.astype("<u4"))],
                "words": [pack_strings(enc.dictionary)],
                "counts": [pack(counts.astype("<u4"))],
                "n_distinct": [len(enc.dictionary)],
                "n_train": [int(train.sum() + (~held).sum())],
                "train_docs": [int((~held).sum())],
            })

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.withColumn("held_out", F.coalesce(crc == 2, F.lit(False))).mapInArrow(cut, "block long, doc_ids binary, held binary, n_words binary, at binary, words binary, counts binary, n_distinct long, n_train long, train_docs long")


def count_words(blocks: DataFrame, ranges: int) -> DataFrame:
    """For each block and range of word hashes: block, at (places in the block's table), totals (corpus counts of those
    words); and, in rows with a null block, each range's own sums and most frequent words."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed, counts in zip(batch["block"].to_pylist(), batch["words"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                words, n = unpack_strings(packed), unpack(counts, "<u4")
                to = (hash_strings(words) % np.uint64(ranges)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                ends = np.searchsorted(to[order], np.arange(ranges + 1))
                for r in np.flatnonzero(np.diff(ends)):
                    at = order[ends[r] : ends[r + 1]]
                    yield pa.RecordBatch.from_pydict({"range": [int(r)], "block": [block], "at": [pack(at.astype("<u4"))], "words": [pack_strings(words.take(pa.array(at)))], "counts": [pack(n[at])]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in ranges_of(batches):
            place: dict[str, int] = {}
            parts: list[tuple[int, bytes, np.ndarray]] = []
            totals = np.zeros(1024, np.int64)
            for row in rows:
                where = np.fromiter((place.setdefault(w, len(place)) for w in unpack_strings(row["words"]).to_pylist()), np.int64)
                if len(place) > len(totals):
                    totals = np.concatenate([totals, np.zeros(max(len(totals), len(place)), np.int64)])
                totals[where] += unpack(row["counts"], "<u4")  # a block's words are distinct
                parts.append((row["block"], row["at"], where.astype(np.uint32)))
            totals = totals[: len(place)]
            for block, at, where in parts:
                yield pa.RecordBatch.from_pydict({"block": [block], "at": [at], "totals": [pack(totals[where].astype("<u8"))], "n": [0], "v": [0], "top": [None], "top_n": [None], "ends": [None], "ends_n": [None], "ends_v": [None]}, schema=COUNTED)
            if len(place):
                yield sums_of(pa.array(list(place), pa.string()), totals)
            del place, parts, totals
            release()

    dealt = blocks.select("block", "words", "counts").mapInArrow(deal, "range long, block long, at binary, words binary, counts binary")
    # a task takes its ranges one after the other
    sorted_ = dealt.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "range").sortWithinPartitions("range")
    return sorted_.mapInArrow(add, "block long, at binary, totals binary, n long, v long, top array<string>, top_n array<long>, ends array<string>, ends_n array<long>, ends_v array<long>")


def sums_of(words: pa.Array, totals: np.ndarray) -> pa.RecordBatch:
    """A range's row without a block: sum and number of its words, the most frequent ones, sums by ending."""
    seen = pa.array(totals > 0)
    most = min(TOP, len(totals))
    # by count, then by the word's bytes, as the choice over all ranges is made: no tie depends on arrival
    often = np.flatnonzero(totals >= np.partition(totals, -most)[-most])
    often = often[np.asarray(pc.sort_indices(words.take(pa.array(often)).cast(pa.binary())))]
    best = often[np.argsort(-totals[often], kind="stable")][:TOP]
    last = pc.utf8_slice_codeunits(words.filter(seen), -2)
    by_end = pa.table({"e": last, "c": pa.array(totals).filter(seen)}).group_by("e").aggregate([("c", "sum"), ("c", "count")])
    return pa.RecordBatch.from_pydict({"block": [None], "at": [None], "totals": [None], "n": [int(totals.sum())], "v": [int((totals > 0).sum())], "top": [words.take(pa.array(best)).to_pylist()], "top_n": [totals[best].tolist()], "ends": [by_end["e"].to_pylist()], "ends_n": [by_end["c_sum"].to_pylist()], "ends_v": [by_end["c_count"].to_pylist()]}, schema=COUNTED)


COUNTED = pa.schema([("block", pa.int64()), ("at", pa.binary()), ("totals", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("top", pa.list_(pa.string())), ("top_n", pa.list_(pa.int64())), ("ends", pa.list_(pa.string())), ("ends_n", pa.list_(pa.int64())), ("ends_v", pa.list_(pa.int64()))])


def symbols_of(words: pa.Array, top: list[str], ends: list[str]) -> np.ndarray:
    """The symbol of each word: its own, or that of its class."""
    own = pc.fill_null(pc.index_in(words, pa.array(top, pa.string())), -1) if top else pa.array(np.full(len(words), -1, np.int32))
    cls = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(words, -2), pa.array(ends, pa.string())), CLASSES - 1) if ends else pa.array(np.full(len(words), CLASSES - 1, np.int32))
    own, cls = np.asarray(own).astype(np.int64), np.asarray(cls).astype(np.int64)
    return np.where(own >= 0, own, TOP + cls)


def sequences(row: dict, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: word index of each token (-1: the end), the token's symbol, the two before it, document ends, held-out flags."""
    n = unpack(row["n_words"], "<u4").astype(np.int64) + 1
    ends = np.cumsum(n)
    total = int(ends[-1])
    word = np.full(total, -1, np.int64)
    inner = np.ones(total, bool)
    inner[ends - 1] = False
    word[inner] = unpack(row["at"], "<u4")
    w = np.full(total, END, np.int64)
    w[inner] = symbols[word[inner]]
    first = ends - n
    b = np.concatenate([[START], w[:-1]])
    b[first] = START
    a = np.concatenate([[START], b[:-1]])
    a[first] = START
    held = np.unpackbits(np.frombuffer(row["held"], np.uint8), count=len(n)).astype(bool)
    return word, w, a, b, ends, held


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
            release()


def triple_counts(blocks: DataFrame, top: list[str], ends: list[str]) -> np.ndarray:
    """Counts of (a, b, w) over all training documents, as rows of code and count. At most SYMBOLS^3 of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            _, w, a, b, last, held = sequences(row, symbols_of(unpack_strings(row["words"]), top, ends))
            train = np.repeat(~held, np.diff(np.concatenate([[0], last])))
            code, n = np.unique(((a * SYMBOLS + b) * SYMBOLS + w)[train].astype(np.uint32), return_counts=True)
            for r in range(RANGES):
                mine = code % RANGES == r
                if mine.any():
                    yield pa.RecordBatch.from_pydict({"range": [r], "code": [pack(code[mine].astype("<u4"))], "n": [pack(n[mine].astype("<u4"))]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for row in rows_of(batches):
            s = sums.setdefault(row["range"], np.zeros(SYMBOLS**3 // RANGES + 1, np.int64))
            s[unpack(row["code"], "<u4") // RANGES] += unpack(row["n"], "<u4")
        for r, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_pydict({"code": [pack((at * RANGES + r).astype("<u4"))], "n": [pack(s[at].astype("<u8"))]})

    parts = blocks.select("n_words", "at", "held", "words").mapInArrow(count, "range long, code binary, n binary").repartition(RANGES, "range").mapInArrow(add, "code binary, n binary").toLocalIterator()
    got = [(unpack(bytes(p.code), "<u4"), unpack(bytes(p.n), "<u8")) for p in parts]
    if not got:
        return np.zeros((2, 0), np.int64)
    return np.stack([np.concatenate([g[0] for g in got]).astype(np.int64), np.concatenate([g[1] for g in got]).astype(np.int64)])


RANGES = 32


def train(triples: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """Noise-contrastive estimation over all triples at once: each epoch passes over all contexts in batches of matrix
    products, with the noise's expectation taken exactly (NOISE noise words for each word of the corpus)."""
    rng = np.random.default_rng(seed)
    p = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in {"ra": (SYMBOLS, DIM), "rb": (SYMBOLS, DIM), "q": (SYMBOLS, DIM)}.items()}
    code, n = triples
    unigram = np.bincount(code % SYMBOLS, n, SYMBOLS) + 0.5 if len(code) else np.ones(SYMBOLS)
    noise = (unigram / unigram.sum()).astype(np.float32)
    p["bias"] = np.log(noise)
    if not len(code):
        return p
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    ctx, w = code // SYMBOLS, code % SYMBOLS
    ctxs, start = np.unique(ctx, return_index=True)
    start = np.append(start, len(code))
    total = n.sum()
    shift = np.log(NOISE * noise)
    state = {k: np.full_like(v, 1e-8) for k, v in p.items()}
    step = 4096
    for epoch in range(EPOCHS):
        g = {k: np.zeros_like(v) for k, v in p.items()}
        for at in range(0, len(ctxs), step):
            to = min(at + step, len(ctxs))
            a, b = ctxs[at:to] // SYMBOLS, ctxs[at:to] % SYMBOLS
            lo, hi = start[at], start[to]
            seen = np.zeros((to - at, SYMBOLS), np.float32)
            seen[np.repeat(np.arange(to - at), np.diff(start[at : to + 1])), w[lo:hi]] = n[lo:hi] / total
            h = p["ra"][a] + p["rb"][b]
            odds = 1 / (1 + np.exp(shift - (h @ p["q"].T + p["bias"])))  # that it comes from the corpus, not from noise
            grad = seen * (1 - odds) - NOISE * seen.sum(1, keepdims=True) * noise * odds
            g["q"] += grad.T @ h
            g["bias"] += grad.sum(0)
            back = grad @ p["q"]
            np.add.at(g["ra"], a, back)
            np.add.at(g["rb"], b, back)
        for k, v in p.items():
            state[k] += g[k] ** 2
            v += RATE * g[k] / np.sqrt(state[k])
    return p


def log_probabilities(model: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Normalised natural-log probabilities of symbols w after a, b. Equal contexts share a row of the matrix product."""
    code = a * SYMBOLS + b
    there = np.flatnonzero(np.bincount(code, minlength=SYMBOLS * SYMBOLS))
    norm = np.zeros(SYMBOLS * SYMBOLS, np.float32)
    allowed = np.where(np.arange(SYMBOLS) == START, -np.inf, model["bias"]).astype(np.float32)  # no text holds the start
    for at in range(0, len(there), 8192):
        c = there[at : at + 8192]
        s = (model["ra"][c // SYMBOLS] + model["rb"][c % SYMBOLS]) @ model["q"].T + allowed
        top = s.max(axis=1)
        norm[c] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
    by_a, by_b = model["ra"] @ model["q"].T, model["rb"] @ model["q"].T
    return (by_a.reshape(-1)[a * SYMBOLS + w] + by_b.reshape(-1)[b * SYMBOLS + w] + allowed[w] - norm[code]).astype(np.float64)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of all documents."""
    spark = docs.sparkSession
    blocks = bucketed(blocks_of(docs, id_col, text_col), "lm_blocks", "block", int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = written(count_words(blocks, ranges_for(blocks)), "lm_counts")
    ends_total = blocks.agg(F.sum("n_train").alias("n"), F.sum("train_docs").alias("docs")).first()
    n_all, n_end = int(ends_total.n or 0), int(ends_total.docs or 0)
    sums = counted.filter("block IS NULL")
    v_all = int(sums.agg(F.sum("v").alias("v")).first().v or 0) + (n_end > 0)
    pairs = sums.select(F.explode(F.arrays_zip("top", "top_n")).alias("t")).select("t.top", "t.top_n").filter("top_n > 0")
    top_rows = pairs.orderBy(F.desc("top_n"), "top").limit(TOP).collect()
    by_end = sums.select(F.explode(F.arrays_zip("ends", "ends_n", "ends_v")).alias("t")).groupBy("t.ends").agg(F.sum("t.ends_n").alias("n"), F.sum("t.ends_v").alias("v"))
    end_rows = by_end.orderBy(F.desc("n"), "ends").limit(CLASSES - 1).collect()
    top, ends = [r.top for r in top_rows], [r.ends for r in end_rows]
    # tokens and distinct words of each class, less the TOP's
    size, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    size[: len(ends)], kinds[: len(ends)] = [r.n for r in end_rows], [r.v for r in end_rows]
    size[-1], kinds[-1] = n_all - n_end - size.sum(), v_all - (n_end > 0) - kinds.sum()
    for r in top_rows:
        k = ends.index(r.top[-2:]) if r.top[-2:] in ends else CLASSES - 1
        size[k], kinds[k] = size[k] - r.top_n, kinds[k] - 1
    model = train(triple_counts(blocks, top, ends))
    parts = counted.filter("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("at", "totals")).alias("parts"))
    placed = blocks.join(parts, "block", "left")
    sent = spark.sparkContext.broadcast((model, top, ends, size, kinds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, top, ends, size, kinds = sent.value
        for row in rows_of(batches):
            words = unpack_strings(row["words"])
            symbols = symbols_of(words, top, ends)
            count = np.zeros(len(words) + 1, np.int64)
            for p in row["parts"] or []:
                count[unpack(p["at"], "<u4")] = unpack(p["totals"], "<u8")
            count[-1] = n_end  # word -1 is the end
            word, w, a, b, last, held = sequences(row, symbols)
            c = count[word]
            base = np.log10((c + 1) / (n_all + 1 * (v_all + 1)))
            got = log_probabilities(model, a, b, w) / np.log(10)
            inside = np.zeros(len(count))
            in_class = symbols >= TOP
            k = symbols[in_class] - TOP
            inside[:-1][in_class] = np.log10((count[:-1][in_class] + 1) / (size[k] + kinds[k] + 1))
            got += inside[word]
            first = np.concatenate([[0], last[:-1]])
            yield pa.RecordBatch.from_arrays(
                [unpack_strings(row["doc_ids"]), pa.array(held), pa.array(last - first), pa.array(np.add.reduceat((c > 0).astype(np.int64), first)), pa.array(np.full(len(last), n_all)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(got, first))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return placed.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: scores of all documents."""
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
