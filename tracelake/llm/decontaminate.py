"""Benchmark decontamination: CGK random-walk embedding, repeated bit-sampling LSH over item-sized windows, and exact
edit verification.

Symbols are words: lower-cased, without what is neither letter nor digit (words without either vanish). Letters of
scripts without spaces (Han, kana, Thai, Lao, Khmer, Myanmar) are words of their own. A document is contaminated by an
item of n words if one of its windows is within floor(EDITS * n) word edits (insertions, deletions, substitutions) of it.

1. q-gram lemma: such a window keeps at least n - 1 - 2k of the item's word pairs within n + k words. Windows that hold
   fewer word pairs of the whole benchmark can't match and are left out; this loses nothing.
2. CGK: a walk over a window of n words writes, at each step, the word it stands on, and moves on or stays by a random
   bit of the word and step. Few edits give few differing steps, so edit distance becomes Hamming distance. Bit sampling:
   each walk is sampled at SAMPLES steps, which gives a key; a window of n words that shares a key with an item of n words
   is a candidate. Windows have the sizes of the items. The number of walks is derived for each band of sizes from RECALL:
   walks_for() measures, at the limit of edits, how many walks find a share RECALL of the items, up to WALKS.
3. Pigeonhole: k edits leave one of k + 1 pieces of an item as it is. The pieces are looked up exactly, and where one
   stands the item is a candidate, so no match of any length is left to chance. Items of fewer than five words allow no
   edit: their one piece is the item.
4. Each candidate is verified by exact edit distance, so there are no false matches.

The benchmark is a table of its own; it is taken in parts of at most PART_WORDS words, each with a bounded size, and the
documents are passed once for each part.

Defined results: a null or empty text has no match; an item without a word is found nowhere; null ids are carried as they
are; repeated rows each give their rows; empty tables give no row; very long texts are searched whole; other columns pass
through clean() whatever their names, and matches() ignores them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import BLOCK_BYTES, hash_strings, held, list_parts, mix64, one_chunk, ragged, string_parts, text_blocks

#: Share of an item's words that may be edited; share of copies at that limit that the walks find; sampled steps of a walk.
EDITS, RECALL, SAMPLES = 0.2, 0.95, 3
#: Items whose numbers of words are within this factor share walks, from this number of words on (fewer allow no edit).
WIDEN, WALKED = 1.25, 5
#: Most walks of a band, enough up to about 200 words; longer items than MEASURED words take as many. Pieces find the rest.
WALKS, MEASURED = 96, 400
#: Beginnings of windows that walk together.
STARTS = 1 << 18
#: Words of the benchmark in one pass; bits of the table of word pairs.
PART_WORDS, PAIR_BITS = 4_000_000, 28
#: Bytes of text that are searched together: a block's distinct words become strings of the worker.
BLOCK = BLOCK_BYTES >> 1
#: Places of pieces that are looked at together.
PLACES = 1 << 20
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


_OTHER = re.compile(r"[\W_]+")


def plain(word: str) -> str:
    low = word.lower()
    return low if low.isalnum() else _OTHER.sub("", low)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by text and a 64-bit code for each of its words, those without letter or digit left out."""
    # these scripts are at U+0E00 and beyond, whose bytes begin with 0xE0 at least
    if len(texts) and (string_parts(texts)[1] >= 0xE0).any():
        texts = pc.replace_substring_regex(texts, _UNSPACED, r" \1 ")
    off, flat = list_parts(pc.ascii_split_whitespace(texts))
    enc = flat.dictionary_encode()
    words = pa.array([plain(w) for w in enc.dictionary.to_numpy(zero_copy_only=False)], pa.string())
    code = hash_strings(words) | np.uint64(1)
    code[np.asarray(pc.equal(words, ""))] = 0
    seq = code[np.asarray(enc.indices)]
    full = seq != 0
    return np.concatenate([[0], np.cumsum(full)])[off], seq[full]


def pair_codes(seq: np.ndarray) -> np.ndarray:
    """A code for each word and the next."""
    return mix64(seq[:-1] * _PAIR + seq[1:])


def run_codes(seq: np.ndarray, at: np.ndarray, g: int) -> np.ndarray:
    """A code for each run of g words that begins at one of the places."""
    code = np.full(len(at), np.uint64(g))
    for k in range(g):
        code = mix64(code * _PAIR + seq[at + k])
    return code


@cache
def factors(repeat: int, bits: int) -> np.ndarray:
    """Odd numbers for the first 2^bits steps of a walk."""
    return mix64((np.uint64(repeat) << np.uint64(20)) + np.arange(1, (1 << bits) + 1, dtype=np.uint64)) | np.uint64(1)


def walk(seq: np.ndarray, starts: np.ndarray, repeat: int, steps: np.ndarray) -> np.ndarray:
    """Where a walk from each start stands at each of the steps (in order); what bounds its window doesn't change it."""
    at = starts.astype(np.int64)
    out = np.empty((len(steps), len(at)), np.int64)
    row, end = 0, len(seq) - 1
    odd = factors(repeat, int(steps[-1]).bit_length())
    for step in range(int(steps[-1]) + 1):
        if step == steps[row]:
            out[row] = at
            row += 1
        # a random bit of word and step: the highest one of a product with an odd factor
        at = at + ((seq[np.minimum(at, end)] * odd[step]) >> np.uint64(63)).astype(np.int64)
    return out


def keys_of(seq: np.ndarray, starts: np.ndarray, n: int, repeat: int, at: np.ndarray) -> np.ndarray:
    """Keys of windows of n words from where their walk stands at the sampled steps. Past the window it writes zeros."""
    key = np.full(len(starts), np.uint64((n << 12) + repeat))
    for place in at:
        key = mix64(key * _PAIR + np.where(place < starts + n, seq[np.minimum(place, len(seq) - 1)], np.uint64(0)))
    return key


@cache
def sampled_steps(n: int, repeat: int) -> np.ndarray:
    """The sampled steps of a walk over n words; drawn once for all. Walks have left the window after about 2n steps."""
    rng = np.random.default_rng((n, repeat))
    return np.sort(rng.choice(max(SAMPLES, 2 * n - n // 4), SAMPLES, replace=False))


@cache
def walks_for(n: int) -> int:
    """So many walks that they find a share RECALL of items of n words in texts that hold them with floor(EDITS * n) random
    edits, over all windows around them: measured on random words; WALKS at most."""
    if n > MEASURED:
        return WALKS
    rng = np.random.default_rng(n)
    k = int(EDITS * n)
    trials = max(60, min(200, 20_000 // (4 * k + 1)))
    items, texts = [], []
    for _ in range(trials):
        item = rng.integers(1, 1 << 63, n).astype(np.uint64)
        words = item.tolist()
        for kind in rng.integers(0, 3, k):
            place = int(rng.integers(0, len(words)))
            # 0 replaces, 1 inserts, 2 deletes
            words[place : place + (kind != 1)] = [] if kind == 2 else [int(rng.integers(1, 1 << 63))]
        around = rng.integers(1, 1 << 63, (2, 2 * k)).astype(np.uint64)
        items.append(item)
        texts.append(np.concatenate([around[0], np.array(words, np.uint64), around[1], rng.integers(1, 1 << 63, 2 * n).astype(np.uint64)]))
    begins = np.cumsum([len(t) for t in texts]) - [len(t) for t in texts]
    item_seq, text_seq = np.concatenate(items), np.concatenate(texts)
    left = np.arange(trials)
    for r in range(WALKS):
        steps, own, starts = sampled_steps(n, r), left * n, (begins[left, None] + np.arange(4 * k + 1)).reshape(-1)
        want = keys_of(item_seq, own, n, r, walk(item_seq, own, r, steps))
        got = keys_of(text_seq, starts, n, r, walk(text_seq, starts, r, steps)).reshape(len(left), -1)
        left = left[~(got == want[:, None]).any(axis=1)]
        if len(left) <= (1 - RECALL) * trials:
            return r + 1
    return WALKS


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least word edits between the item and any stretch of text; where that stretch begins and ends."""
    m = len(text)
    cost, begin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    ramp = np.arange(m + 1)
    for i, w in enumerate(item):
        up, take = cost + 1, cost[:-1] + (text != w)
        new, origin = up.copy(), begin.copy()
        better = take <= new[1:]
        new[1:][better], origin[1:][better] = take[better], begin[:-1][better]
        # insertions: a running minimum of new - position
        low = np.minimum.accumulate(new - ramp)
        source = np.maximum.accumulate(np.where(new - ramp == low, ramp, 0))
        cost, begin = low + ramp, origin[source]
    end = int(cost.argmin())
    return int(cost[end]), int(begin[end]), end


class Items:
    """One part of the benchmark, ready to be searched for."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        off, seq = word_codes(pa.array([t or "" for t in texts], pa.string()))
        words = [seq[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
        kept = [(i, w) for i, w in zip(ids, words, strict=True) if len(w)]
        self.ids, self.words = [i for i, _ in kept], [w for _, w in kept]
        self.bits = min(PAIR_BITS, max(16, int(np.ceil(np.log2(64 * max(1, sum(map(len, self.words))))))))
        self.pairs = np.zeros(1 << self.bits, bool)
        for w in self.words:
            self.pairs[(pair_codes(w) >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        #: bands of similar numbers of words: number of walks, and for each number of words its keys with their items, walk by walk
        self.bands: list[tuple[int, dict[int, list[tuple[np.ndarray, np.ndarray]]]]] = []
        size = np.array([len(w) for w in self.words], np.int64)
        sizes = np.unique(size[size >= WALKED]).tolist()
        while sizes:
            mine = [n for n in sizes if n <= WIDEN * sizes[0]]
            sizes = sizes[len(mine) :]
            walks, tables = walks_for(mine[-1]), {}
            for n in mine:
                which = np.flatnonzero(size == n)
                joined, own = np.concatenate([self.words[k] for k in which]), np.arange(len(which)) * n
                tables[n] = []
                for r in range(walks):
                    keys = keys_of(joined, own, n, r, walk(joined, own, r, sampled_steps(n, r)))
                    order = np.argsort(keys, kind="stable")
                    tables[n].append((keys[order], which[order]))
            self.bands.append((walks, tables))
        #: by words of a piece: sorted codes of pieces with their items and places in them
        self.pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        rows: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for i, w in enumerate(self.words):
            k = int(EDITS * len(w))
            g = len(w) // (k + 1)
            at = np.arange(k + 1) * g
            rows.setdefault(g, []).append((run_codes(w, at, g), np.full(k + 1, i), at))
        for g, parts in rows.items():
            code, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(code, kind="stable")
            self.pieces[g] = code[order], item[order], at[order]

    def whole_pieces(self, off: np.ndarray, seq: np.ndarray, doc: np.ndarray, upto: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Documents, items and supposed beginnings (maybe before the document) where a piece of an item stands."""
        n = np.array([len(w) for w in self.words])
        k = (EDITS * n).astype(np.int64)
        for g, (codes, items, places) in self.pieces.items():
            # all word pairs of a piece are the benchmark's
            at = np.flatnonzero(upto[g - 1 :] - upto[: len(upto) - g + 1] == g - 1)
            got = run_codes(seq, at, g)
            lo, hi = np.searchsorted(codes, got, "left"), np.searchsorted(codes, got, "right")
            # bounded runs of places at a time, also where many items have a piece in common
            w = np.flatnonzero(hi > lo)
            cuts = np.searchsorted(np.cumsum(hi[w] - lo[w]), np.arange(1, int((hi[w] - lo[w]).sum()) // PLACES + 1) * PLACES)
            for part in np.split(w, cuts):
                if not len(part):
                    continue
                lens = hi[part] - lo[part]
                flat = ragged(lo[part], lens)
                item, stands = items[flat], np.repeat(at[part], lens)
                d, begin = doc[stands], stands - places[flat]
                # the item's word pairs that must be left stand within its edits of here
                first = np.maximum(begin - k[item], off[d])
                last = np.minimum(begin + n[item] + k[item], off[d + 1]) - 1
                some = upto[last] - upto[first] >= n[item] - 1 - 2 * k[item]
                yield d[some], item[some], begin[some]

    def windows(self, seq: np.ndarray, at: np.ndarray, upto: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Beginnings of windows and items that share a key with them."""
        last = len(upto) - 1
        for walks, tables in self.bands:
            starts = {}
            for n in tables:
                k = int(EDITS * n)
                first = at[upto[np.minimum(at + n + k, last)] - upto[at] >= n - 1 - 2 * k]
                # windows begin where the first pair that is left stands, or up to 2k words before
                mine = np.unique((first[:, None] - np.arange(2 * k + 1)).reshape(-1))
                starts[n] = mine[mine >= 0]
            union = np.unique(np.concatenate(list(starts.values())))
            for low in range(0, len(union), STARTS):
                part = union[low : low + STARTS]
                inside = {n: np.searchsorted(part, mine[(mine >= part[0]) & (mine <= part[-1])]) for n, mine in starts.items()}
                inside = {n: w for n, w in inside.items() if len(w)}
                for r in range(walks):
                    steps = np.unique(np.concatenate([sampled_steps(n, r) for n in inside]))
                    stands = walk(seq, part, r, steps)
                    for n, w in inside.items():
                        keys, items = tables[n][r]
                        got = keys_of(seq, part[w], n, r, stands[np.searchsorted(steps, sampled_steps(n, r))][:, w])
                        lo, hi = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
                        hits = np.flatnonzero(hi > lo)
                        if len(hits):
                            lens = hi[hits] - lo[hits]
                            yield np.repeat(part[w[hits]], lens), items[ragged(lo[hits], lens)]

    def search(self, off: np.ndarray, seq: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, begin, end, edits) for each document and item that match: the fewest edits, then the first."""
        if not len(seq) or not self.words:
            return []
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
        hit = self.pairs[(pair_codes(seq) >> np.uint64(64 - self.bits)).astype(np.int64)] & (doc[:-1] == doc[1:])
        upto = np.concatenate([[0], np.cumsum(hit)])
        at = np.flatnonzero(hit)
        candidates = list(self.whole_pieces(off, seq, doc, upto))
        if len(at):
            pairs = [np.stack(x, axis=1) for x in self.windows(seq, at, upto)]
            if pairs:
                where, which = np.unique(np.concatenate(pairs), axis=0).T
                candidates.append((doc[where], which, where))
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        if not candidates:
            return []
        in_doc, which, where = (np.concatenate(x) for x in zip(*candidates, strict=True))
        # candidates of one document and item that overlap are verified together
        order = np.lexsort((where, which, in_doc))
        in_doc, which, where = in_doc[order], which[order], where[order]
        size = np.array([len(w) for w in self.words])
        group = np.flatnonzero(np.concatenate([[True], (np.diff(which) != 0) | (np.diff(where) > size[which[1:]]) | (np.diff(in_doc) != 0)])) if len(where) else []
        for a, b in zip(group, [*group[1:], len(where)], strict=True):
            d, i = int(in_doc[a]), int(which[a])
            n = len(self.words[i])
            k = int(EDITS * n)
            lo, hi = max(int(off[d]), int(where[a]) - k), min(int(off[d + 1]), int(where[b - 1]) + n + k)
            edits, begin, end = edit_distance(self.words[i], seq[lo:hi])
            if edits <= k and ((d, i) not in found or (edits, lo + begin) < (found[d, i][2], found[d, i][0])):
                found[d, i] = (lo + begin, lo + end, edits)
        return [(d, i, b - int(off[d]), e - int(off[d]), n) for (d, i), (b, e, n) in sorted(found.items())]


def parts_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[tuple[list, list]]:
    """The benchmark in parts of at most PART_WORDS words (one item at least), one at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        n = len((r.t or "").split())
        if ids and size + n > PART_WORDS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.i)
        texts.append(r.t)
        size += n
    if ids:
        yield ids, texts


def _items(sent) -> Items:
    """The items of a broadcast part."""
    ids, texts, key = sent.value
    return held(("items", key), lambda: Items(ids, texts))


MATCHES = "doc_id long, item_id long, begin long, end long, edits long"


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, begin, end (in words that have letters or digits), edits: one row for each document and item."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], MATCHES)
    for ids, texts in parts_of(benchmark):
        sent = spark.sparkContext.broadcast((ids, texts, uuid.uuid4().hex))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = None
            for block in text_blocks(batches, limit=BLOCK):
                items = items or _items(sent)
                got = items.search(*word_codes(one_chunk(block["text"])))
                if got:
                    d, i, b, e, n = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([one_chunk(block["doc_id"]).take(pa.array(d)), pa.array([items.ids[k] for k in i], pa.int64()), pa.array(b), pa.array(e), pa.array(n)], ["doc_id", "item_id", "begin", "end", "edits"])

        out = out.unionByName(narrow.mapInArrow(find, MATCHES))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs without a match, with their columns; nothing shuffles."""
    where = docs.columns.index(text_col)
    for ids, texts in parts_of(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast((ids, texts, uuid.uuid4().hex))

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                items, found, at = _items(sent), np.zeros(batch.num_rows, bool), 0
                only = pa.RecordBatch.from_arrays([batch.column(where)], ["text"])
                for block in text_blocks(iter([only]), limit=BLOCK):
                    for d, *_ in items.search(*word_codes(one_chunk(block["text"]))):
                        found[at + d] = True
                    at += block.num_rows
                yield batch.filter(pa.array(~found))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents against the whole benchmark."""
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
