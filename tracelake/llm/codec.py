"""Exact encoding through word tables: the tokenizers library's ids at the cost of its distinct words.

A text is split as the tokenizer's own pre-tokenizer splits it, each distinct word is encoded once by the tokenizer's
model, and the ids are put back by position. Texts of common characters are split with compiled patterns; any other text
goes through the library's own pre-tokenizer, so the ids are the library's in every case.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tracelake.llm.common import held, list_parts, ragged

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Letters, digits and white space among the characters of _COMMON, by Unicode category.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \xa0"
_COMMON = "\t-\r -~\xa0-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf"
_BYTE_WORDS = re.compile(f"'(?:[sdmt]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_L}{_N}{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_LOWER_WORDS = re.compile(f"'(?:[sdmt]|re|ve|ll)|[{_L}]+|[{_N}]|[^{_L}{_N}{_S}]+")
#: Where a space can't be taken for the start of a word.
_INNER_SPACE = r"[\t-\r \x{a0}] (?:[\t-\r \x{a0}]|\z)"


#: Fixed value: how files must be made for _LOWER_WORDS to split as they do. Other files go through the library as a whole.
LOWER = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Codec:
    """One tokenizer file, with memos of bounded size. Truncation and padding are switched off."""

    def __init__(self, path: str, memo: int = 250_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path) as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocab <= 1 << 16 else "<u4")
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        self.kind = "other"
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        plain = plain and spec["post_processor"] is None and not any(t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word"))
        if plain and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec["normalizer"] is None:
            self.kind = "byte"
        elif plain and spec["normalizer"] == LOWER["normalizer"] and pre == LOWER["pre_tokenizer"]:
            self.kind = "lower"
        self._table = {b: c for b, c in byte_letters().items() if chr(b) != c}
        self._memo: dict[str, bytes] = {}
        self._unit_memo: dict[str, bytes] = {}
        self._limit = memo
        #: pieces by id, and decimal digits with a comma by id, where something needs them
        self.tables: tuple[pa.Array, pa.Array] | None = None

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word as the pre-tokenizer gives it, or of a special token; of a whole text for files of another kind."""
        if self.kind == "other":
            return self.tok.encode(word, add_special_tokens=False).ids
        if word in self.special:
            return [self.special[word]]
        return [t.id for t in self.tok.model.tokenize(word.encode().decode("latin-1").translate(self._table))]

    def _word(self, word: str) -> bytes:
        got = self._memo.get(word)
        if got is None:
            if len(self._memo) >= self._limit:
                self._memo.clear()
            got = self._memo[word] = np.array(self.word_ids(word), self.dtype).tobytes()
        return got

    def split(self, text: str) -> list[str]:
        """Words of a text of common characters without special tokens."""
        return _BYTE_WORDS.findall(text) if self.kind == "byte" else _LOWER_WORDS.findall(text.lower())

    def split_any(self, text: str) -> list[str]:
        """Words of any text; special tokens are words of their own."""
        if not text:
            return []
        if self.kind == "other":
            return [text]
        out: list[str] = []
        parts = re.split("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")", text) if self.special else [text]
        for part in parts:
            if part in self.special:
                out.append(part)
            elif part:
                norm = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
                back = {c: b for b, c in byte_letters().items()}
                out += [bytes(back[c] for c in w).decode() for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(norm)]
        return out

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], list[list[str] | None]]:
        """Split texts into units: (offsets by text, unit of each place, names of units, words of units).

        A unit is what stands between two spaces, or one word of a text that can't be cut so. words is None for a unit
        whose words are split(name); names are unique among those.
        """
        n = len(texts)
        if self.kind == "other":
            enc = texts.dictionary_encode()
            names = enc.dictionary.to_pylist()
            return np.arange(n + 1), np.asarray(enc.indices).astype(np.int32), names, [self.split_any(name) for name in names]
        odd = pc.match_substring_regex(texts, f"[^{_COMMON}]")
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = np.asarray(odd)
        cut = np.asarray(pc.match_substring_regex(texts, _INNER_SPACE)) if self.kind == "byte" else np.zeros(n, bool)
        quick = ~odd & ~cut
        off, flat = list_parts(pc.split_pattern(texts.filter(pa.array(quick)), " "))
        enc = flat.dictionary_encode()
        code = np.asarray(enc.indices).astype(np.int32)
        pieces = enc.dictionary.to_numpy(zero_copy_only=False).tolist()
        words: list[list[str] | None]
        if self.kind == "byte":
            firsts = off[:-1]
            used, where = np.unique(code[firsts], return_inverse=True)
            code[firsts] = len(pieces) + where
            names = [" " + p for p in pieces] + [pieces[u] for u in used]
            words = [None] * len(pieces) + [self.split(pieces[u]) for u in used]
        else:
            names, words = pieces, [None] * len(pieces)
        lens = np.zeros(n, np.int64)
        starts = np.zeros(n, np.int64)
        lens[quick], starts[quick] = np.diff(off), off[:-1]
        if not quick.all():
            place: dict[str, int] = {}
            rest: list[np.ndarray] = []
            at = len(code)
            for i in np.flatnonzero(~quick):
                text = texts[int(i)].as_py()
                got = self.split_any(text) if odd[i] else self.split(text)
                for w in got:
                    if w not in place:
                        place[w] = len(names)
                        names.append(w)
                        words.append([w])
                lens[i], starts[i] = len(got), at
                rest.append(np.fromiter((place[w] for w in got), np.int32, len(got)))
                at += len(got)
            code = np.concatenate([code, *rest])
        return np.concatenate([[0], np.cumsum(lens)]), code[ragged(starts, lens)], names, words

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids in one array."""
        if self.kind == "other":
            got = [e.ids for e in self.tok.encode_batch([t.as_py() for t in texts], add_special_tokens=False)]
            return np.array([len(g) for g in got], np.int64), np.array([i for g in got for i in g], self.dtype)
        off, code, names, words = self.units(texts)
        memo, word = self._unit_memo, self._word
        if len(memo) >= self._limit:
            memo.clear()
        coded = []
        for name, own in zip(names, words, strict=True):
            if own is not None:
                coded.append(b"".join([word(w) for w in own]))
                continue
            got = memo.get(name)
            if got is None:
                got = b"".join([word(w) for w in self.split(name)])
                if len(memo) < self._limit:
                    memo[name] = got
            coded.append(got)
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // self.dtype.itemsize
        pool = np.frombuffer(b"".join(coded), self.dtype)
        begin = np.cumsum(size) - size
        ids = pool[ragged(begin[code], size[code])]
        upto = np.concatenate([[0], np.cumsum(size[code])])
        return np.diff(upto[off]), ids


def codec(path: str) -> Codec:
    """The codec of a file."""
    return held(("codec", path), lambda: Codec(path))
