"""The pipeline's stages, each against brute force on its own input; edge cases; the whole run."""

import hashlib
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.001"
SPACE = re.compile("[\x20\x09-\x0d]+")


def shingles(text, width=5):
    w = [x for x in SPACE.split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) > width else {tuple(w)} - {()}


def plain(text):
    return [x for w in (text or "").lower().split() if (x := re.sub(r"[\W_]+", "", w))]


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def near_kept(rows):
    """One of each group linked by a similarity of 0.8, the smallest id; texts without a shingle are alike."""
    sets = [shingles(r.text) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and alike(sets[i], sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return sorted(min(rows[k].doc_id for k in range(len(rows)) if label[k] == g) for g in set(label))


def within(item, text, k):
    """Whether a stretch of text is within k edits of the item."""
    # an edit takes away one of the item's words at most
    if len(set(item) - set(text)) > k:
        return False
    row = list(range(len(item) + 1))
    for x in text:
        new = [0]
        for n, w in enumerate(item):
            new.append(min(row[n + 1] + 1, new[n] + 1, row[n] + (x != w)))
        row = new
        if row[-1] <= k:
            return True
    return row[-1] <= k or len(item) <= k


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # a copy of a long text with a changed word, and one with a repeated line
    rows = docs.collect()
    long = next(r for r in rows if r.text and len(r.text.split()) > 100)
    w = long.text.split()
    more = [(9001, " ".join([*w[:50], "changed", *w[51:]])), (9002, long.text + "\n" + " ".join(w[:20] * 30)), (9003, None), (9004, "123"), (9005, "one two three four five six")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in more], docs.schema))
    benchmark = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        out = corpus_pipeline.written(stage(spark, docs, SF), f"test-{name}")
        got = sorted(r.doc_id for r in out.collect())
        if name == "language":
            want = sorted(r.doc_id for r in rows if any(c.isalpha() for c in r.text or ""))
        elif name == "exact":
            best = {}
            for r in rows:
                key = SPACE.sub("", r.text or "")
                best[key] = min(best.get(key, (0, 1 << 62)), (-len(r.text or ""), r.doc_id))
            want = sorted(i for _, i in best.values())
        elif name == "near":
            want = near_kept(rows)
            assert len(want) < len(rows) and not {9001, 9002} & set(want)
        elif name == "benchmark":
            want = sorted(r.doc_id for r in rows if not any(within(i, plain(r.text), int(0.2 * len(i))) for i in benchmark))
            assert len(want) < len(rows)
        else:
            tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            want = sorted(r.doc_id for r in rows)
            full = {r.doc_id: r for r in out.collect()}
            for r in rows:
                ids = tok.encode(r.text, add_special_tokens=False).ids
                assert (full[r.doc_id].n_tokens, full[r.doc_id].ids_sha256, full[r.doc_id].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(r.text))
        assert got == want, name
        if name != "tokens":
            assert out.columns == docs.columns
        docs = out


def test_stages_with_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __lang string, __found boolean, sha string, fp long, node long, u long, row string"
    odd = [(None, "a text", None), (None, None, "en"), (1, None, None), (2, "", "en"), (3, "a text", "en"), (3, "a text", "en"), (4, "lang text " * 40_000, "en"), (5, "日本語", None)]
    docs = spark.createDataFrame([(i, t, lang, None, None, "x", True, "s", 1, 2, 3, "r") for i, t, lang in odd], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = sorted(r.doc_id or 0 for r in out.collect())
        assert kept == {"language": [0, 3, 3, 4, 5], "exact": [1, 3, 4, 5], "near": [0, 0, 1, 3, 3, 4, 5], "benchmark": [0, 0, 1, 2, 3, 3, 4, 5]}[name], name
        assert stage(spark, docs.filter("doc_id > 99"), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(odd)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 50 < got.count() < 200
