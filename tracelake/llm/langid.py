"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled texts. A text is parsed into phrases,
each the longest match of what follows in a language's sample (at least one letter); the language whose sample needs the
fewest phrases wins. Phrase counts are normalised: count times log2(sample size) over letters gives the cross-parsing
entropy in bits a letter, so that samples of different sizes compare.

Whole texts are parsed. They are cut into pieces of PIECE letters that are parsed at once in numpy; a piece whose
predecessor ends inside a phrase is parsed again from there until both parses begin a phrase at the same letter, from
which on they are equal. So the phrases are those of one parse from the first letter to the last. Letters are
lower-cased code points, and each letter of a language's sample has a symbol of its own; all that is no letter is a gap.

The sample: of each language documents in order of a hash of their id, up to SAMPLE letters; a document gives a stretch
of at most SLICE characters, at a place that the hash names. Over all languages the samples have at most SAMPLES letters:
with more than SAMPLES / SAMPLE labels each gets an equal share. DRAWN times a sample's letters are drawn, at random by
the hash, to choose from. No label is left out. These bounds are parameters; learning sees text and label only,
prediction the text only.

Defined results: a null text, or one without a letter, is `und` with score 0; with nothing learned every text is `und`
(keep_known() then still keeps texts with a letter); ties go to the language first in alphabetical order; a null doc_id
is not held out and not learned from; repeated rows each give their row; an empty table gives no row. identify() replaces
columns named __lang and __score; all columns pass through keep_known() whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import BLOCK_BYTES, held, plus, release

SAMPLE, SAMPLES, SLICE, DRAWN, PIECE = 60_000, 4_000_000, 8_000, 4, 128
#: Entries of the tables of moves over all languages; beyond them moves are looked up by binary search.
DENSE = 24 << 20


class SuffixAutomaton:
    """All substrings of one sequence of symbols, as a table of moves (-1: no such substring)."""

    def __init__(self, symbols: np.ndarray, alphabet: int, dense: int = DENSE):
        moves: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for s in symbols.tolist():
            new = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and s not in moves[p]:
                moves[p][s] = new
                p = link[p]
            if p >= 0:
                q = moves[p][s]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(moves)
                    moves.append(dict(moves[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and moves[p].get(s) == q:
                        moves[p][s] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.width = alphabet
        self.keys = self.table = None
        if len(moves) * alphabet <= dense:
            self.table = np.full(len(moves) * alphabet, -1, np.int32)
            for k, m in enumerate(moves):
                if m:
                    self.table[k * alphabet + np.fromiter(m, np.int64, len(m))] = list(m.values())
        else:
            order = [(k * alphabet + s, to) for k, m in enumerate(moves) for s, to in sorted(m.items())]
            self.keys, self.to = np.array([x[0] for x in order], np.int64), np.array([x[1] for x in order], np.int32)
        self.start = self.move(np.zeros(alphabet, np.int64), np.arange(alphabet))

    def move(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if self.keys is None:
            return self.table[state * self.width + symbol]
        at = state.astype(np.int64) * self.width + symbol
        if not len(self.keys):
            return np.full(len(at), -1, np.int32)
        where = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
        return np.where(self.keys[where] == at, self.to[where], -1)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state, and whether the symbol begins a phrase; also one that the sample doesn't have begins one."""
        to = self.move(state, symbol)
        fresh = (to < 0) | (state == 0)
        return np.where(fresh, np.maximum(self.start[symbol], 0), to), fresh

    def phrases(self, grid: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        """Phrases that begin in each column of grid; symbols below zero end a column.

        A column that isn't `first` goes on where the one before it ends.
        """
        columns = grid.shape[1]
        first = np.ones(columns, bool) if first is None else first
        state, begun = np.zeros(columns, np.int32), np.zeros(grid.shape, bool)
        for t, row in enumerate(grid):
            live = row >= 0
            to, fresh = self.step(state, np.where(live, row, 0))
            begun[t] = fresh & live
            state = np.where(live, to, state)
        alone, ended = state, state.copy()
        count, change = begun.sum(axis=0, dtype=np.int64), np.zeros(columns, np.int64)
        todo = np.flatnonzero(~first)
        todo = todo[ended[todo - 1] != 0]
        while len(todo):
            before = ended[todo]
            ended[todo] = alone[todo]
            change[todo] = 0
            # the states before are of this round's beginning: a column changed now is passed on in the next round
            state = np.where(np.isin(todo - 1, todo), before[np.searchsorted(todo, todo - 1)], ended[todo - 1])
            open_ = todo
            for t, row in enumerate(grid):
                s = row[open_]
                live = s >= 0
                open_, state, s = open_[live], state[live], s[live]
                if not len(open_):
                    break
                to, fresh = self.step(state, s)
                there = begun[t, open_]
                change[open_] += fresh.astype(np.int64) - there
                apart = ~(fresh & there)
                open_, state = open_[apart], to[apart]
            ended[open_] = state
            moved = todo[ended[todo] != before] + 1
            moved = moved[moved < columns]
            todo = moved[~first[moved]]
        return count + change


def letters() -> np.ndarray:
    """By code point: that of the lower-cased letter, 0 for what is no letter."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = ord(chr(c).lower()[0])
    return out


class Model:
    """Automata by language, each over the letters of its own sample."""

    def __init__(self, samples: dict[str, str], dense: int = DENSE):
        self.languages = sorted(samples)
        lower = letters()
        points = {k: lower[self._points(t)] for k, t in samples.items()}
        known = np.unique(np.concatenate([np.zeros(0, np.int32), *points.values()]))
        known = known[known > 0]
        #: number of each code point: 0 gap, 1 a letter that no sample has
        number = np.ones(0x110000, np.int32)
        number[0] = 0
        number[known] = np.arange(len(known)) + 2
        self.number = number[lower]
        self.automata, self.symbols, self.weight = {}, {}, {}
        for k in self.languages:
            seq, _ = self.sequences([samples[k]])
            own = np.unique(seq)
            own = own[own > 1]
            #: symbol of each number in this language's automaton: 0 gap, 1 any letter that its sample lacks
            table = np.ones(len(known) + 2, np.int32)
            table[0] = 0
            table[own] = np.arange(len(own)) + 2
            self.symbols[k] = table
            self.automata[k] = SuffixAutomaton(table[seq], len(own) + 2, dense // len(samples))
            self.weight[k] = float(np.log2(len(seq) + 2))

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)

    def sequences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts in a row, runs of gaps made one, and how many each text has."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = self.number[self._points("".join(texts))]
        keep = np.ones(len(flat), bool)
        keep[1:] = (flat[1:] != 0) | (flat[:-1] != 0)
        ends = np.cumsum(size)
        begins = (ends - size)[size > 0]
        keep[begins] = True
        upto = np.concatenate([[0], np.cumsum(keep)])
        return flat[keep], np.diff(upto[np.concatenate([[0], ends])])

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol of each text under each language (texts by languages), and the number of symbols."""
        flat, n = self.sequences(texts)
        pieces = -(-n // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        out = np.zeros((len(texts), len(self.languages)))
        if not len(owner):
            return out, n
        # piece k of a text holds its symbols k*PIECE .. ; the grid has a column for each piece
        grid = np.full((len(owner), PIECE), -1, np.int32)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        begin = np.cumsum(pieces) - pieces
        grid[np.repeat(begin, n) + pos // PIECE, pos % PIECE] = flat
        grid = np.ascontiguousarray(grid.T)
        first = np.zeros(len(owner), bool)
        first[begin[pieces > 0]] = True
        for k, lang in enumerate(self.languages):
            # the last entry of the table stands for the end
            phrases = self.automata[lang].phrases(np.append(self.symbols[lang], -1)[grid], first)
            out[:, k] = np.bincount(owner, phrases, len(texts)) * self.weight[lang] / np.maximum(n, 1)
        return out, n

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text (all have a letter), and its share among weights that halve with each tenth of a bit."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        cost, _ = self.costs(texts)
        best = cost.argmin(axis=1)
        weight = np.exp2(-10 * (cost - cost.min(axis=1, keepdims=True)))
        return [self.languages[b] for b in best], 1 / weight.sum(axis=1)

    def predict_all(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language and score of each text of a batch, and whether it has a letter."""
        texts = pc.fill_null(column.cast(pa.string()), "")
        lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        spelt = np.asarray(pc.match_substring_regex(texts, r"\pL"))
        at = np.flatnonzero(spelt)
        size = np.cumsum(np.asarray(pc.binary_length(texts), np.int64)[at])
        k = 0
        while k < len(at):
            to = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + (BLOCK_BYTES >> 3), "right")))
            lang[at[k:to]], score[at[k:to]] = self.predict(texts.take(pa.array(at[k:to])).to_pylist())
            k = to
        return lang, score, spelt


def _model(sent) -> Model:
    """The model of a broadcast sample."""
    samples, key = sent.value
    return held(("languages", key), lambda: Model(samples))


def fold(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = SAMPLE, total: int = SAMPLES) -> dict[str, str]:
    """A bounded sample of labelled texts by language: of documents that aren't held out, with a label."""
    known = docs.filter((fold(id_col) != 1) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.lit(8)).alias("h"))
    counts = known.groupBy("lang").agg(F.sum(F.least(F.length("text"), F.lit(SLICE))).alias("n")).collect()
    if not counts:
        return {}
    size = min(size, max(1, total // len(counts)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, DRAWN * size / max(1, r.n)))])
    part = (F.col("h").cast("double") / F.lit(2.0**64)) + 0.5
    place = F.pmod(F.col("h"), F.greatest(F.length("text") - SLICE, F.lit(0)) + 1).cast("int") + 1
    got: dict[str, list] = {}
    for r in known.filter(part <= F.element_at(share, F.col("lang"))).select("lang", "h", F.substring("text", place, F.lit(SLICE)).alias("text")).collect():
        got.setdefault(r.lang, []).append((r.h, r.text))
    out = {}
    for lang, rows in got.items():
        texts, n = [], 0
        for _, text in sorted(rows):
            texts.append(text)
            n += len(text)
            if n >= size:
                break
        if any(c.isalpha() for t in texts for c in t):
            out[lang] = "\n".join(texts)[: size + SLICE]
    return out


def identify(docs: DataFrame, learned: dict[str, str], text_col: str = "text") -> DataFrame:
    """docs with the columns __lang and __score; learned: samples by language."""
    docs = docs.drop("__lang", "__score")
    sent = docs.sparkSession.sparkContext.broadcast((learned, uuid.uuid4().hex))
    names = docs.columns
    where = names.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, _ = _model(sent).predict_all(batch.column(where))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*names, "__lang", "__score"])
            release()

    return docs.mapInArrow(predict, plus(docs.schema, __lang=T.StringType(), __score=T.DoubleType()))


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose text has a language, with their columns."""
    learned = samples(docs, id_col, text_col, lang_col)
    sent = docs.sparkSession.sparkContext.broadcast((learned, uuid.uuid4().hex))
    where = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, _, spelt = _model(sent).predict_all(batch.column(where))
            yield batch.filter(pa.array(lang != "und" if learned else spelt, pa.bool_()))
            release()

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the language of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), samples(docs))
    return found.select("doc_id", F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
