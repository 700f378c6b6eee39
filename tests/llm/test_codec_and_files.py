"""Encoding, id files, token counts and the word table against the tokenizers library."""

import hashlib
import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracelake.llm import common, token_counts, token_ids, word_table
from tracelake.llm.codec import Codec

TEXTS = [
    None, "", " ", "   ", "a", "a  b", "a   b", "a \n b", "a\n \nb", "trailing  ", " lead", "It's we'll they'RE", "x<|endoftext|>y <|startoftext|> z", "naïve café ÀÉ 12 345 ½",
    "日本語 テキスト", "emoji 😀 ok", "tab\there\r\nnew", "İstanbul ΣΑΣ", "é nfc", "\x1c\x85 odd", "a\xa0\xa0b", "!!' s 's", "word " * 5000,
]
BYTE, LOWER = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module", params=[BYTE, LOWER], ids=["byte", "lower"])
def both(request):
    return Codec(request.param, memo=50), Tokenizer.from_file(request.param)


@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="ab 'st\n\t1!é\xa0", max_size=30)), max_size=5))
@settings(max_examples=150, deadline=None)
def test_ids_are_the_librarys(both, texts):
    code, tok = both
    n, ids = code.encode(pa.array(texts, pa.string()))
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@given(st.lists(st.integers(0, 10**6), max_size=300))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values):
    values = np.sort(np.array(values, np.int64))
    ef = token_ids.EliasFano.build(values)
    assert ef.all().tolist() == values.tolist()
    assert [ef.select(i) for i in range(len(values))] == values.tolist()


def docs(spark, rows=None):
    return spark.createDataFrame(rows if rows is not None else [*enumerate(TEXTS), (None, "no id"), (3, "   ")], "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS n_tokens", "1 AS start")


def test_id_files(spark, tmp_path):
    path = f"file://{tmp_path}/ids"
    token_ids.write_ids(docs(spark), LOWER, path, file_ids=2000)
    got = token_ids.read_ids(spark, path).collect()
    assert len(got) == len(TEXTS) + 2
    got.sort(key=lambda r: r.start)
    assert got[0].doc_id is None
    ids = [r.doc_id for r in got[1:]]
    assert ids == sorted(ids)
    want = {k: [*w, 1] for k, w in enumerate(library(LOWER, TEXTS))}
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
        if r.doc_id not in (None, 3):
            assert (r.n_tokens, r.ids_crc32) == (len(want[r.doc_id]), zlib.crc32(np.array(want[r.doc_id], "<u4").tobytes()))


def test_id_files_of_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    token_ids.write_ids(docs(spark, []), LOWER, path)
    assert token_ids.read_ids(spark, path).count() == 0


def test_word_table(spark):
    got = {}
    for r in word_table.digests(docs(spark), BYTE).collect():
        got.setdefault(r.doc_id, []).append(r)
    tok = Tokenizer.from_file(BYTE)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for k, ids in enumerate(library(BYTE, TEXTS)):
        assert (len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))) in [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got[k]]
    assert len(got[None]) == 1 and len(got[3]) == 2
    assert word_table.digests(docs(spark, []), BYTE).count() == 0


def test_encode_and_decode_tables(spark):
    ids = word_table.encoded(docs(spark), BYTE)
    back = {r.doc_id: r.text for r in word_table.decoded(ids, BYTE).collect()}
    assert all(back[k] == (t or "") for k, t in enumerate(TEXTS) if k != 3)


def test_token_counts(spark):
    lens = np.array([len(i) for i in library(BYTE, [*TEXTS, "no id", "   "])])
    sums = token_counts.suffix_sums(token_counts.length_histogram(docs(spark), BYTE))
    for r in sums.collect():
        assert (r.n_docs, r.docs_from, r.tokens_from, r.tokens_cut) == ((lens == r.n_tokens).sum(), (lens >= r.n_tokens).sum(), lens[lens >= r.n_tokens].sum(), np.minimum(lens, r.n_tokens).sum())
    for limit in (0, 1, 7, 100, 10**6):
        assert sums.agg(token_counts.cut_total(limit).alias("v")).first().v == np.minimum(lens, limit).sum()
    assert sums.agg(token_counts.quantile(0.5).alias("v")).first().v == np.sort(lens)[int(np.ceil(0.5 * len(lens))) - 1]
    assert token_counts.suffix_sums(token_counts.length_histogram(docs(spark, []), BYTE)).count() == 0


def other_file(tmp_path):
    """The lower-casing file with another pattern: digits in runs."""
    spec = json.load(open(LOWER))
    split = spec["pre_tokenizer"]["pretokenizers"][0]
    split["pattern"]["Regex"] = split["pattern"]["Regex"].replace("[\\p{N}]|", "[\\p{N}]+|")
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    return str(path)


def test_files_of_another_pattern(spark, tmp_path):
    path = other_file(tmp_path)
    code = Codec(path)
    texts = [t or "" for t in TEXTS] + ["12 345", "12 345"]
    n, ids = code.encode(pa.array(texts))
    want = library(path, texts)
    assert ids.tolist() == [i for w in want for i in w] and want[-1] != library(LOWER, texts)[-1]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    tok = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in word_table.digests(docs(spark, [*enumerate(texts)]), path).collect()}
    for k, w in enumerate(want):
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(w), sha(",".join(map(str, w))), sha(tok.decode(w, skip_special_tokens=False)))


def test_small_tables_of_words_change_nothing(spark, monkeypatch):
    want = word_table.digests(docs(spark), BYTE).collect()
    monkeypatch.setattr(word_table, "TABLE_WORDS", 3)
    monkeypatch.setattr(common, "RANGE_WORDS", 5)
    assert sorted(word_table.digests(docs(spark), BYTE).collect(), key=str) == sorted(want, key=str)


def test_id_files_of_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    start, want = 0, {}
    for r, w in zip(rows, library(LOWER, [r.text for r in rows]), strict=True):
        w = [*w, 1]
        want[r.doc_id] = (start, len(w), zlib.crc32(np.array(w, "<u4").tobytes()))
        start += len(w)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_ids.query(spark, sf).collect()} == want
