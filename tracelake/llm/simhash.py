"""SimHash near-duplicates by tiled exact comparison: numpy exclusive-or and bit counts.

Every text gets a fingerprint. Distinct fingerprints are dealt into cells by population counts of the quarters of the
64-bit word (population counts of words that differ in r bits differ by at most r, quarter by quarter, in sum), so that
cells further apart than the radius are skipped without looking at a fingerprint. A cell is compared with itself and
with the later cells in reach, tile by tile; tiles are sorted by population count and tile pairs that differ by more
than the radius are skipped again. Cells with more than STRIP fingerprints are cut into strips, each a task's group of
its own. What leaves a task is a forest over the fingerprints it has linked, never all pairs; components are found by
star contraction over tables.

A text's words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; shingles are runs of words joined by a space, repeats
included (fewer words: the whole sequence). A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42).

Defined results: null and empty texts have fingerprint zero, linked like any other; repeated rows each give their row;
a null doc_id counts as none when the smallest id is taken; an empty table gives no row; other columns pass through
keep_one() whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import mix64, one_chunk, plus, ragged, string_parts, written
from tracelake.llm.components import components

#: Fingerprints in a strip of a cell, in a chunk of what comes to it, and in a tile.
STRIP, CHUNK, TILE = 1 << 16, 1 << 19, 2048
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def bit_sums(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit, lowest bit first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        whole = len(bits) // 255 * 255
        # sums of 255 rows fit in a byte
        total += bits[:whole].reshape(whole // 255, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[whole:].sum(axis=0, dtype=np.uint8)
    return total


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    one, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(one, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(begins[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(one[a:b], 42) for a, b in spans), np.uint64, len(words) - width + 1)


def to_word(sums: np.ndarray, n: int) -> np.uint64:
    return np.packbits(2 * sums > n, bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, width: int, text_col: str = "text") -> DataFrame:
    """docs with the column __fp (long): the fingerprint."""
    names = [*docs.columns, "__fp"]
    schema = plus(docs.schema, __fp=T.LongType())
    where = docs.columns.index(text_col)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(where).cast(pa.string()), "")
            off, data = string_parts(texts)
            view = memoryview(data)
            fp = np.zeros(len(texts), np.uint64)
            for i in range(len(texts)):
                h = shingle_hashes(bytes(view[off[i] : off[i + 1]]), width)
                if len(h):
                    fp[i] = to_word(bit_sums(h), len(h))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], names)

    return docs.mapInArrow(mark, schema)


def neighbours(radius: int) -> list[tuple[int, ...]]:
    """Steps from a cell to itself and to the later cells whose quarters' counts differ by radius in sum at most."""
    steps = [s for s in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, s)) <= radius]
    return [s for s in steps if s >= (0, 0, 0, 0)]


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index reachable from each of n over pairs that come in parts."""
    label = np.arange(n)
    for i, j in pairs:
        while len(i):
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            label = label[label]
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
    while (label[label] != label).any():
        label = label[label]
    return label


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int, more: tuple[np.ndarray, np.ndarray, int] | None = None, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i of a, j of b) that differ in radius bits at most, tile by tile; same: b is a, and i < j is enough.

    more: second words of a and b, and the radius over both words.
    """
    pa_, pb = np.bitwise_count(a).astype(np.int16), np.bitwise_count(b).astype(np.int16)
    oa, ob = np.argsort(pa_, kind="stable"), np.argsort(pb, kind="stable")
    sa, sb, ca, cb = a[oa], b[ob], pa_[oa], pb[ob]
    for x in range(0, len(a), TILE):
        low, high = ca[x], ca[min(x + TILE, len(a)) - 1]
        # tiles of b outside this range differ beyond the radius in population count
        first, last = np.searchsorted(cb, low - radius, "left"), np.searchsorted(cb, high + radius, "right")
        first = max(first, x) if same else first
        for y in range(int(first), int(last), TILE):
            d = np.bitwise_count(sa[x : x + TILE, None] ^ sb[None, y : min(y + TILE, int(last))])
            i, j = np.nonzero(d <= radius)
            i, j = oa[i + x], ob[j + y]
            if same:
                keep = i != j
                i, j = i[keep], j[keep]
            if more is not None and len(i):
                keep = np.bitwise_count(a[i] ^ b[j]).astype(np.int16) + np.bitwise_count(more[0][i] ^ more[1][j]) <= more[2]
                i, j = i[keep], j[keep]
            if len(i):
                yield i, j


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal key in batches sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch["key"])
        ends = [*(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        at = 0
        for to in ends:
            part = batch.slice(at, to - at)
            if held and held[0]["key"][0].as_py() != part["key"][0].as_py():
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(part)
            at = to
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _link(dealt: DataFrame, radius: int, total: int | None) -> DataFrame:
    """Compare each group (key; home: side A, else side B) and return forest edges u, v between node numbers."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            home = np.asarray(one_chunk(group["home"]))
            if not home.any():
                continue
            node = np.asarray(one_chunk(group["node"]))
            fp = np.asarray(one_chunk(group["fp"])).view(np.uint64)
            fp2 = np.asarray(one_chunk(group["fp2"])).view(np.uint64) if total is not None else None
            # home rows first
            order = np.argsort(~home, kind="stable")
            node, fp = node[order], fp[order]
            fp2 = fp2[order] if fp2 is not None else None
            k = int(home.sum())
            first_chunk = not group["key"][0].as_py() & ((1 << 20) - 1)
            own = (fp2[:k], fp2[:k], total) if fp2 is not None else None
            rest = (fp2[:k], fp2[k:], total) if fp2 is not None else None

            def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                if first_chunk:
                    yield from near_pairs(fp[:k], fp[:k], radius, own, same=True)
                for i, j in near_pairs(fp[:k], fp[k:], radius, rest):
                    yield i, j + k

            label = _forest(len(fp), pairs())
            u = np.flatnonzero(label != np.arange(len(fp)))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[label[u]])], ["u", "v"])

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "key").sortWithinPartitions("key").mapInArrow(compare, "u long, v long")


def _deal(cells: DataFrame, steps: list[int]) -> DataFrame:
    """Rows (node, fp, fp2, cell) dealt to groups of bounded size.

    A row is home in one strip of its own cell, and is compared there with the rows that come to the strip: from the
    cell's later strips and from the cells that a step leads to. What comes is cut into chunks, and home rows stand in
    each. Counts of cells are a table with a bound (the number of cells).
    """
    counts = {r.cell: r.n for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = [(c, -(-n // STRIP), max(1, -(-sum(counts.get(c + s, 0) for s in steps) // CHUNK))) for c, n in sorted(counts.items())]
    table = cells.sparkSession.createDataFrame(sizes or [(0, 1, 1)], "to long, strips long, chunks long").hint("broadcast")
    zero = F.lit(0).cast("long")
    own = F.pmod(F.xxhash64("node"), F.col("strips"))
    rows = cells.withColumn("to", F.explode(F.array(*[F.col("cell") - F.lit(s) for s in steps]))).join(table, "to")
    strips = F.when(F.col("to") == F.col("cell"), F.sequence(zero, own)).otherwise(F.sequence(zero, F.col("strips") - 1))
    rows = rows.withColumn("own", own).withColumn("strip", F.explode(strips))
    home = (F.col("to") == F.col("cell")) & (F.col("strip") == F.col("own"))
    chunks = F.when(home, F.sequence(zero, F.col("chunks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks"))))
    rows = rows.withColumn("home", home).withColumn("chunk", F.explode(chunks))
    key = F.shiftleft(F.col("to"), 40) + F.shiftleft(F.col("strip"), 20) + F.col("chunk")
    return rows.select(key.alias("key"), "home", "node", "fp", "fp2")


def quarter_cell(fp: Column) -> Column:
    """Population counts of the four quarters, as one number."""
    quarter = [F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("long") for k in range(4)]
    return ((quarter[0] * 64 + quarter[1]) * 64 + quarter[2]) * 64 + quarter[3]


def link_fingerprints(fps: DataFrame, radius: int) -> DataFrame:
    """Forest edges between distinct fingerprints (column fp) that differ in radius bits at most."""
    cells = fps.select(F.col("fp").alias("node"), "fp", F.lit(0).cast("long").alias("fp2"), quarter_cell(F.col("fp")).alias("cell"))
    steps = [((s[0] * 64 + s[1]) * 64 + s[2]) * 64 + s[3] for s in neighbours(radius)]
    return _link(_deal(cells, steps), radius, None)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = written(fingerprints(narrow, width).select("doc_id", F.col("__fp").alias("fp")), "fingerprints")
    fps = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(link_fingerprints(fps, radius))
    rooted = fps.join(found, fps["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The stage's fingerprint: 128 bits over distinct shingles of five words. Texts with a Jaccard similarity of 0.8 differ
#: in 19.4 bits on average (standard deviation 4.1), unrelated ones in 64 (5.7). The radius only finds candidates.
STAGE_WIDTH, STAGE_RADIUS, STAGE_FIRST = 5, 32, 20
#: Distinct shingles and texts in a block of a group of candidates; two blocks meet in a task.
BLOCK_SHINGLES, BLOCK_TEXTS = 1 << 20, 4096
#: Candidates (48 bytes each) that are broadcast at most.
SENT = 1 << 20
#: Sets of so many shingles at most are compared as sets: bits of few shingles tell neither like nor unlike texts.
SMALL = 20


def sketches(docs: DataFrame, width: int, ratio: float) -> DataFrame:
    """doc_id, fp, fp2, n (distinct shingles), same (a digest of the set of shingles), prefix of docs (doc_id, text).

    prefix: of a small set, the least shingles, so many that sets of a Jaccard similarity of ratio have one in common.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = string_parts(pc.fill_null(batch["text"], ""))
            view = memoryview(data)
            fp, n, same = np.zeros((len(off) - 1, 2), np.uint64), np.zeros(len(off) - 1, np.int64), []
            prefix = []
            for i in range(len(off) - 1):
                h = np.unique(shingle_hashes(bytes(view[off[i] : off[i + 1]]), width))
                n[i] = len(h)
                prefix.append(h[: len(h) - int(np.ceil(ratio * len(h) - 1e-9)) + 1].view(np.int64) if 0 < len(h) <= SMALL else [])
                same.append(xxhash.xxh3_128_digest(h.tobytes()))
                if len(h):
                    fp[i] = to_word(bit_sums(h), len(h)), to_word(bit_sums(mix64(h)), len(h))
            words = [pa.array(fp[:, k].copy().view(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *words, pa.array(n), pa.array(same, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], ["doc_id", "fp", "fp2", "n", "same", "prefix"])

    return docs.mapInArrow(mark, "doc_id long, fp long, fp2 long, n long, same binary, prefix array<long>")


def similar_forest(fp: np.ndarray, fp2: np.ndarray, off: np.ndarray, shingles: np.ndarray, side: np.ndarray | None, radius: int, ratio: float) -> np.ndarray:
    """Smallest index reachable from each text over pairs within the radius whose exact Jaccard similarity is ratio at least.

    Text i has the distinct shingles shingles[off[i]:off[i + 1]], sorted; side: only texts of different sides are compared.
    Pairs that are joined already are not looked at.
    """
    size = np.diff(off)
    label = np.arange(len(size))
    order = np.argsort(size, kind="stable")
    # each shingle in which two sets differ changes one bit of these at most
    bits = np.zeros(len(size), np.uint64)
    if len(shingles):
        bits[size > 0] = np.bitwise_or.reduceat(np.uint64(1) << (shingles & np.uint64(63)), off[:-1][size > 0])
    last = np.searchsorted(size[order], np.floor(size[order] / ratio + 1e-9), "right")
    for at, i in enumerate(order.tolist()):
        j = order[at + 1 : last[at]]
        j = j[label[j] != label[i]]
        if side is not None:
            j = j[side[j] != side[i]]
        near = np.bitwise_count(fp[j] ^ fp[i]).astype(np.int16) + np.bitwise_count(fp2[j] ^ fp2[i]) <= radius
        few = np.bitwise_count(bits[j] ^ bits[i]) <= (1 - ratio) / (1 + ratio) * (size[j] + size[i]) + 1e-9
        j = j[np.where(size[j] <= SMALL, few, near)]
        if not len(j):
            continue
        own = shingles[off[i] : off[i + 1]]
        if not len(own):
            # sorted by size: the others have no shingle either
            alike = j
        else:
            theirs = shingles[ragged(off[j], size[j])]
            hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
            common = np.add.reduceat(hit, np.cumsum(size[j]) - size[j], dtype=np.int64)
            alike = j[common >= ratio * (size[i] + size[j] - common) - 1e-9]
        if len(alike):
            joined = np.unique(label[np.append(alike, i)])
            label[np.isin(label, joined)] = joined[0]
    return label


def verified(texts: DataFrame, candidates: DataFrame, width: int, radius: int, ratio: float) -> DataFrame:
    """Forest edges u, v between the nodes of each group of candidates (node, root, fp, fp2, n) that are similar exactly.

    Only candidates' texts come along. A group is cut into blocks of bounded size, and each two blocks meet in a task.
    """
    zero = F.lit(0).cast("long")
    ceil = lambda n, k: F.ceil(n / F.lit(k)).cast("long")
    sizes = candidates.groupBy("root").agg(F.greatest(ceil(F.sum("n"), BLOCK_SHINGLES), ceil(F.count(F.lit(1)), BLOCK_TEXTS)).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = candidates.join(sizes, "root").withColumn("own", own)
    # so few candidates are sent to the texts, so that no other text moves; more meet the texts in a merge join
    dealt = F.broadcast(dealt) if candidates.count() <= SENT else dealt.hint("merge")
    dealt = texts.select(F.col("doc_id").alias("node"), "text").join(dealt, "node")
    dealt = dealt.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    key = F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other"))
    # the block's side in its pair; a block with itself has one side
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select(key.alias("key"), "node", "fp", "fp2", side.cast("long").alias("side"), "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            if group.num_rows < 2:
                continue
            node, fp, fp2, side = (np.asarray(one_chunk(group[c])) for c in ("node", "fp", "fp2", "side"))
            off, data = string_parts(pc.fill_null(one_chunk(group["text"]), ""))
            view = memoryview(data)
            sets = [np.unique(shingle_hashes(bytes(view[a:b]), width)) for a, b in zip(off[:-1], off[1:], strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
            label = similar_forest(fp.view(np.uint64), fp2.view(np.uint64), ends, np.concatenate(sets), side if side.any() else None, radius, ratio)
            u = np.flatnonzero(label != np.arange(len(node)))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[label[u]])], ["u", "v"])

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "key").sortWithinPartitions("key").mapInArrow(compare, "u long, v long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = STAGE_WIDTH, first: int = STAGE_FIRST, radius: int = STAGE_RADIUS, ratio: float = 0.8) -> DataFrame:
    """docs with one document of each group of near-duplicates: the one with the smallest id.

    Two texts are linked when their sets of shingles have a Jaccard similarity of `ratio` at least. Candidates are texts
    whose 128-bit fingerprints differ in `radius` bits at most (in the first word: `first`), and small sets that share one
    of their least shingles, which all similar ones do (texts without a shingle are one set); each link is verified on the
    shingles themselves (as 64-bit hashes). Cells are ranges of the number of distinct shingles, and only equal and adjacent
    ones are compared: texts of a similarity of `ratio` are never further apart in size. Rows with a null id all stay.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL")
    marked = written(sketches(narrow, width, ratio), "fingerprints")
    cell = F.floor(F.log(F.greatest(F.col("r.n"), F.lit(1)).cast("double")) / F.log(F.lit(1 / (ratio - 0.02)))).cast("long")
    # texts with the same set of shingles are one node
    distinct = written(marked.groupBy("same").agg(F.min(F.struct("doc_id", "fp", "fp2", "n", "prefix")).alias("r")).select("same", F.col("r.doc_id").alias("node"), "r.fp", "r.fp2", "r.n", "r.prefix", cell.alias("cell")), "distinct")
    # what is similar to a set of SMALL * ratio shingles at most is small too
    large = distinct.filter(F.col("n") > SMALL * ratio).select("node", "fp", "fp2", "cell")
    tokens = distinct.select("node", F.explode("prefix").alias("token"))
    # written, so that both sides of the join are plain exchanges, which Spark can split where a token is frequent
    least = written(tokens.groupBy("token").agg(F.min("node").alias("v"), F.max("node").alias("w")).filter("v < w").select("token", "v"), "tokens")
    small = tokens.join(least, "token").filter("node <> v").select(F.col("node").alias("u"), "v")
    near = components(_link(_deal(large, [0, 1]), first, radius).unionByName(small))
    roots = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    edges = verified(narrow, written(distinct.join(roots, "node").select("node", "root", "fp", "fp2", "n"), "candidates"), width, radius, ratio)
    same = marked.select("doc_id", "same").join(distinct.select("same", "node"), "same").filter("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    dropped = components(edges.unionByName(same)).select(F.col("node").alias("__node"))
    return docs.join(dropped, docs[f"`{id_col}`"] == dropped["__node"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: fingerprints of all documents and their components."""
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
