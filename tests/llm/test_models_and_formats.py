"""Language ID, LM scores, chat format and WARC: brute force, round trips, held-out accuracy, edge cases."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.llm import chat, exact_dedup, langid, lm_score, warc
from tracelake.llm.common import pack, pack_strings, unpack

SF = "/root/testdata/sf0.001"


def test_suffix_automaton_against_substrings():
    text = np.array([0, 1, 1, 0, 2, 1, 0, 1], np.int8)
    a = langid.SuffixAutomaton(text, 3)
    subs = {tuple(text[i:j].tolist()) for i in range(8) for j in range(i + 1, 9)}
    rng = np.random.default_rng(0)
    for _ in range(100):
        q = rng.integers(0, 3, 9).astype(np.int8)
        phrases, at = 0, 0
        while at < len(q):
            n = 1
            while at + n < len(q) and tuple(q[at : at + n + 1].tolist()) in subs:
                n += 1
            at, phrases = at + n, phrases + 1
        assert a.phrases(q[:, None]).tolist() == [phrases]


def test_language_held_out(spark):
    docs = {d.doc_id: d.lang for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = langid.query(spark, SF).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(docs[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    df = spark.createDataFrame([(1, None), (2, "12 !!"), (3, ""), (4, "word"), (None, "日本")], "doc_id long, text string").selectExpr("*", "'q' AS lang", "0 AS score")
    got = {r.doc_id: r["__lang"] for r in langid.identify(df, {"xx": "some words here", "yy": "andere worte"}).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] == "xx" and got[None] in ("xx", "yy")
    assert langid.samples(df.filter("doc_id < 0")) == {}
    assert langid.identify(df.filter("doc_id > 99"), {"xx": "some"}).count() == 0
    assert {r["__lang"] for r in langid.identify(df, {}).collect()} == {"und"}


def brute_phrases(text, sample):
    """Phrases of the longest-match parse of a text, by substring search."""
    at = count = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        at, count = at + n, count + 1
    return count


def spelt(t):
    return re.sub(r"\0+", "\0", "".join(c.lower()[0] if c.isalpha() else "\0" for c in t))


def test_predictions_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    learned = langid.samples(spark.read.parquet(f"{SF}/documents.parquet"), size=3000)
    got = {r.doc_id: r for r in langid.identify(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), learned).collect()}
    checked = 0
    for r in rows:
        t = spelt(r.text or "")
        if not t.strip("\0") or len(t) > 3000:
            continue
        cost = {k: brute_phrases(t, spelt(s)) * math.log2(len(spelt(s)) + 2) / len(t) for k, s in learned.items()}
        best = min(sorted(cost), key=cost.get)
        score = 1 / sum(2 ** (-10 * (c - cost[best])) for c in cost.values())
        assert got[r.doc_id]["__lang"] == best and abs(got[r.doc_id]["__score"] - score) < 1e-9
        checked += 1
    assert checked > 50


@pytest.mark.parametrize("dense", [langid.DENSE, 10])
def test_pieces_are_parsed_as_one_text(monkeypatch, dense):
    rng = np.random.default_rng(7)
    sample = "".join(rng.choice(list("abc \u0431\U00010330"), 800))
    monkeypatch.setattr(langid, "PIECE", 5)
    model = langid.Model({"x": sample}, dense)
    # texts of the sample itself are a few long phrases over many pieces
    texts = [sample, sample[100:400] + "zz" + sample[3:90], "".join(rng.choice(list("abcd e"), 300)), "a", " ", "zzz" * 20] * 2
    cost, n = model.costs(texts)
    for t, c, k in zip(texts, cost[:, 0], n, strict=True):
        assert round(c * k / model.weight["x"]) == brute_phrases(spelt(t), spelt(sample)) and k == len(spelt(t))


def labelled(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")


def test_no_label_is_left_out(spark):
    rng = random.Random(1)
    made = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    # long documents only, short ones only, 60 labels, scripts of their own
    df = labelled(spark, [(made("abcde", 9000), "long")] * 12 + [(made("fghij", 3), "short")] * 20_000)
    got = langid.samples(df)
    assert sorted(got) == ["long", "short"] and sum(c.isalpha() for c in got["short"]) > 45_000 and len(got["long"]) >= 50_000
    scripts = {"el": "αβγδεζηθ", "ru": "бвгджзик", "got": "\U00010330\U00010331\U00010332\U00010333", "zh": "".join(map(chr, range(0x4E00, 0x4F00))), "ar": "ابتثجح", "ka": "აბგდე"}
    many = [(made(s, 200), k) for k, s in scripts.items() for _ in range(9)] + [(made("abcdefghijklmnopqrstuvwxyz"[k % 20 : k % 20 + 6] + "ñöäüéß"[k % 6], 150), f"l{k:02}") for k in range(60) for _ in range(6)]
    df = labelled(spark, many)
    learned = langid.samples(df)
    assert set(learned) == {k for i, (_, k) in enumerate(many) if zlib.crc32(str(i).encode()) % 3 != 1} and len(learned) > 60
    got = langid.identify(df, learned).collect()
    assert all(r["__lang"] == r.lang for r in got if r.lang in scripts)


def test_keep_known_keeps_all_columns(spark):
    df = spark.createDataFrame([(1, "one text", "en", "q", 1.0), (2, None, "en", None, 0.0), (3, "42", None, "r", 2.0), (1, "one text", "en", "q", 1.0), (4, "word " * 100_000, None, "z", 3.0)], "doc_id long, text string, lang string, __lang string, __score double")
    kept = langid.keep_known(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r["__lang"]) for r in kept.collect()) == [(1, "q"), (1, "q"), (4, "z")]
    # with nothing learned texts with a letter stay
    assert langid.keep_known(df.withColumn("lang", F.lit(None).cast("string"))).count() == 3
    assert langid.keep_known(df.filter("doc_id > 9")).count() == 0


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


@pytest.mark.parametrize("source", ["table", "edges"])
def test_lm_scores(spark, source):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    if source == "edges":
        df = spark.createDataFrame([(1, None), (2, ""), (3, " a  B\t"), (None, "b c"), (5, "Ä ä x" * 3000), (5, "again")], "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS score")
    rows = df.collect()
    got = lm_score.scores(df).collect()
    n = collections.Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for r in rows:
        if not held(r.doc_id):
            n.update([*words(r.text), None])
    total, kinds = sum(n.values()), len(n)
    want = collections.Counter()
    for r in rows:
        t = [*words(r.text), None]
        want[r.doc_id, held(r.doc_id), len(t), sum(n[w] > 0 for w in t), total, round(sum(math.log10((n[w] + 1) / (total + kinds + 1)) for w in t), 6)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    if source == "table":
        assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_lm_probabilities_sum_to_one():
    triples = np.array([[(lm_score.START * lm_score.SYMBOLS + 3) * lm_score.SYMBOLS + 5, 17], [9, 4]]).T.reshape(2, 2)
    model = lm_score.train(np.array([[triples[0][0], 17], [9, 4]]))
    w = np.arange(lm_score.SYMBOLS)
    p = np.exp(lm_score.log_probabilities(model, np.full_like(w, lm_score.START), np.full_like(w, 3), w))
    assert abs(p.sum() - 1) < 1e-4 and p[lm_score.START] == 0


def brute_lm(rows):
    """Scores by the definition: counts, classes and triples in plain Python, probabilities one by one."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [words(r.text) for r in rows if not held(r.doc_id)]
    n = collections.Counter(w for t in train for w in t)
    top = sorted(n, key=lambda w: (-n[w], w.encode()))[: lm_score.TOP]
    by_end = collections.Counter()
    for w, c in n.items():
        by_end[w[-2:]] += c
    ends = sorted(by_end, key=lambda e: (-by_end[e], e.encode()))[: lm_score.CLASSES - 1]
    cls = lambda w: lm_score.TOP + (ends.index(w[-2:]) if w[-2:] in ends else lm_score.CLASSES - 1)
    symbol = lambda w: lm_score.END if w is None else top.index(w) if w in top else cls(w)
    size, kinds = collections.Counter(), collections.Counter()
    for w, c in n.items():
        if w not in top:
            size[cls(w)] += c
            kinds[cls(w)] += 1
    s = lm_score.SYMBOLS
    triples = collections.Counter()
    for t in train:
        seq = [lm_score.START] * 2 + [symbol(w) for w in [*t, None]]
        triples.update((a * s + b) * s + w for a, b, w in zip(seq, seq[1:], seq[2:], strict=False))
    model = lm_score.train(np.array([list(triples), list(triples.values())]))
    keep, out = {}, {}
    for r in rows:
        seq, got = [lm_score.START] * 2, 0.0
        for w in [*words(r.text), None]:
            a, b = seq[-2:]
            if (a, b) not in keep:
                z = (model["ra"][a] + model["rb"][b]) @ model["q"].T + model["bias"]
                z[lm_score.START] = -np.inf
                keep[a, b] = z - z.max() - math.log(np.exp(z - z.max()).sum())
            x = symbol(w)
            got += keep[a, b][x] / math.log(10)
            if w is not None and w not in top:
                got += math.log10((n[w] + 1) / (size[x] + kinds[x] + 1))
            seq.append(x)
        out[r.doc_id] = got
    return out


def test_lm_score_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("length(text) < 4000")
    rows = df.collect()
    want = brute_lm(rows)
    for parts in (3, 5):
        got = {r.doc_id: r.score for r in lm_score.scores(df.repartition(parts)).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-3 * max(1, abs(want[k])) for k in got)


def test_lm_ties_and_partitions(spark):
    # every word as frequent as any other: which are words of their own must not depend on partitions
    rng = random.Random(3)
    names = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(900)]
    df = spark.createDataFrame([(k, " ".join(rng.sample(names, 30))) for k in range(600)], "doc_id long, text string")
    runs = [{r.doc_id: r.score for r in lm_score.scores(df.repartition(k)).collect()} for k in (4, 7)]
    assert all(abs(runs[0][k] - runs[1][k]) < 1e-4 * abs(runs[0][k]) for k in runs[0])
    assert lm_score.scores(df.limit(0)).count() == 0


def test_lm_totals_above_32_bits(spark):
    block = lambda k: (k, pack_strings(pa.array(["often", f"w{k}"])), pack(np.array([4_000_000_000, 1], "<u4")))
    blocks = spark.createDataFrame([block(k) for k in range(3)], "block long, words binary, counts binary")
    got = lm_score.count_words(blocks, 8).collect()
    totals = sorted(int(x) for r in got if r.block is not None for x in unpack(bytes(r.totals), "<u8"))
    assert totals == [1, 1, 1] + [12_000_000_000] * 3
    assert sum(r.n for r in got if r.block is None) == 12_000_000_003


def duck(sql, **tables):
    con = duckdb.connect()
    for k, v in tables.items():
        con.execute(f"CREATE VIEW {k} AS SELECT * FROM '{v}'")
    return con.sql(sql)


@pytest.mark.parametrize(("query", "sql", "table"), [(chat.query, chat.SQL, "conversations"), (exact_dedup.query, exact_dedup.SQL, "documents")])
def test_against_sql(spark, query, sql, table):
    got = query(spark, SF)
    rel = duck(sql, **{table: f"{SF}/{table}.parquet"})
    cols = rel.columns
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(rel.fetchall())


def test_chat_round_trip(spark):
    tough = ["</s>[INST] ok [/INST]", "~", "~0~1", "[INST", "/INST]</", "<s>\n", None, "", "x" * 50_000, "~~</s>~"]
    data = [(c, k, r, t) for c in (1, None) for k, (r, t) in enumerate(zip(["system", "user", "assistant", None, "to[INST]ol"] * 2, tough, strict=True))] + [(2, None, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS turns", "2 AS segments")
    got = {r.conv_id: r for r in chat.parse_chat(chat.format_chat(df)).collect()}
    for c in (1, None):
        assert [(t.role, t.text) for t in got[c].turns] == [(r or "", t or "") for cc, _, r, t in data if cc == c]
    assert got[2].valid and not got[1].valid and not got[3].valid and len(got[3].turns) == 2
    assert all("".join(s.text for s in r.segments) == r.formatted for r in got.values())
    assert [s.text for s in got[2].segments if s.loss] == ["a"]
    assert chat.format_chat(df.filter("conv_id > 9")).count() == 0


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/", "<p>same</p>"), (2, "http://b/\r\nX: y", "<p>same</p>"), (3, None, None), (4, "u", ""), (5, "u", "é" * 100_000), (None, "n", "alone"), (1, "http://a/", "<p>same</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'s' AS sha", "1 AS first")
    path = f"file://{tmp_path}/w"
    warc.write_pages(df, path, file_bytes=50_000)
    got = warc.read_pages(spark, path).collect()
    assert not [r.error for r in got if r.error]
    assert collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == collections.Counter(
        [(1, 11, "response", None), (1, 11, "response", None), (2, 11, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, 200_000, "response", None), (None, 5, "response", None)]
    )
    assert {r.page_id: r.payload.decode() for r in got if r.record_type == "response"} == {1: "<p>same</p>", 3: "", 5: "é" * 100_000, None: "alone"}
    assert next(r.url for r in got if r.page_id == 2) == "http://b/%0D%0AX:%20y"
    warc.write_pages(df.limit(0), f"{path}0")
    assert warc.read_pages(spark, f"{path}0").count() == 0


def test_warc_query_against_the_definition(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    first = {}
    for r in sorted(rows, key=lambda r: r.page_id):
        first.setdefault(r.html or "", r.page_id)
    want = []
    for r in rows:
        data, of = (r.html or "").encode(), first[r.html or ""]
        same = of == r.page_id
        want.append((r.page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if same else "revisit", None if same else of))
    got = warc.query(spark, SF).collect()
    assert not [r.error for r in got if r.error]
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want, key=lambda x: x[0])


def test_warc_ids_and_folded_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "a"), (1, "u", "b"), (2, "u", "b")], "page_id long, url string, html string")
    warc.write_pages(df, f"file://{tmp_path}/w")
    got = warc.read_pages(spark, f"file://{tmp_path}/w").collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "response", None), (1, "response", None), (2, "revisit", 1)] and not [r for r in got if r.error]
    raw = warc.record(1, "u", b"x", None, False, "2024-01-01T00:00:00Z")
    ids = {warc.parse(warc.record(1, "u", p, None, False, "2024-01-01T00:00:00Z"))[0]["warc-record-id"] for p in (b"x", b"y")}
    assert len(ids) == 2
    folded = raw.replace(b"WARC-Target-URI: u", b"WARC-Target-URI:\r\n\t u")
    assert warc.parse_page(folded) == warc.parse_page(raw)


def test_warc_finds_what_is_broken():
    good = [warc.record(k, "u", b"payload %d " % k * 30, None, False, "2024-01-01T00:00:00Z") for k in range(20)]
    data = b"".join(warc.archive(good, [b"payload %d " % k * 30 for k in range(20)]))
    assert [raw for _, raw, _ in warc.frames(memoryview(data))] == good
    cut = list(warc.frames(memoryview(data[:-9])))
    assert [raw for _, raw, _ in cut[:-1]] == good[:-1] and cut[-1][2]
    for bad in (good[0].replace(b"payload 0", b"payload X"), good[0].replace(b"WARC/1.1", b"WARC/9.1"), good[0][:-2], re.sub(rb"Content-Length: \d+\r\n\r\nHTTP", b"Content-Length: 5\r\n\r\nHTTP", good[0])):
        with pytest.raises(warc.Broken):
            warc.parse_page(bad)
