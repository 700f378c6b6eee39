"""Exact and near duplicates, components, decontamination against brute force; edge cases."""

import random

import numpy as np
import pyarrow as pa

from tracelake.llm import decontaminate, exact_dedup, simhash
from tracelake.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, sha string, maybe string, fp string"


def rows(spark, data):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in data], SCHEMA)


EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "ab"), (6, "a  b"), (6, "a  b"), (None, "a b"), (7, "x" * 200_000), (8, "é"), (9, "\xa0")]


def test_exact_groups(spark):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.groups(rows(spark, EDGE)).collect()}
    assert got == {(1, 3, 3, False), (2, 3, 3, False), (3, 3, 3, True), (4, 6, 5, False), (5, 6, 5, False), (6, 6, 5, True), (None, 6, 5, False), (7, 7, 1, True), (8, 8, 1, True), (9, 9, 1, True)}
    assert exact_dedup.groups(rows(spark, [])).count() == 0


def test_exact_keep(spark):
    kept = exact_dedup.keep(rows(spark, EDGE))
    assert kept.columns == ["doc_id", "text", "sha", "maybe", "fp"]
    assert sorted(r.doc_id for r in kept.collect()) == [3, 6, 7, 8, 9]
    assert exact_dedup.keep(rows(spark, [])).count() == 0


def test_a_full_filter_only_shuffles_more(spark):
    data = [(k, f"text {k % 300}") for k in range(900)]
    want = {(r.doc_id, r.keep_id) for r in exact_dedup.groups(rows(spark, data)).collect()}
    hashed = rows(spark, data).selectExpr("doc_id", "sha2(text, 256) AS sha")
    assert exact_dedup.maybe_repeated(hashed, exact_dedup.MIN_BITS).filter("maybe").count() == 900
    assert want == {(k, k % 300) for k in range(900)}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000, k) for k in range(1001, 1300)] + [(k, k + 1) for k in range(2000, 2060)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {n: got.get(n, n) for n in root} == {n: find(n) for n in root}


def brute(texts):
    fp = np.array([simhash.to_word(simhash.bit_sums(h), len(h)) if len(h := simhash.shingle_hashes((t or "").encode(), 3)) else 0 for t in texts], np.uint64)
    label = list(range(len(fp)))
    for i in range(len(fp)):
        for j in range(i):
            if int(fp[i] ^ fp[j]).bit_count() <= 3 and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return fp, label


def test_simhash_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    fp, label = brute([d.text for d in docs])
    got = {r.doc_id: r for r in simhash.query(spark, SF).collect()}
    assert len(got) == len(docs)
    for k, d in enumerate(docs):
        assert (got[d.doc_id].fingerprint, got[d.doc_id].component_id) == (f"{int(fp[k]):016x}", docs[label[k]].doc_id)


def test_simhash_edges(spark):
    got = {r.doc_id: r for r in simhash.similar_groups(rows(spark, EDGE)).collect()}
    assert got[1].fingerprint == "0" * 16 and got[1].component_id == got[2].component_id == got[3].component_id == 1
    assert len(simhash.similar_groups(rows(spark, EDGE)).collect()) == len(EDGE)
    assert simhash.similar_groups(rows(spark, [])).count() == 0


def test_strips_and_chunks_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60)
    fps = np.unique(np.concatenate([base, base ^ (1 << rng.integers(0, 60, 60)), base ^ (7 << rng.integers(0, 50, 60))]))
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    want = {r.node: r.root for r in components(simhash.link_fingerprints(df, 3)).collect()}
    monkeypatch.setattr(simhash, "STRIP", 2)
    monkeypatch.setattr(simhash, "CHUNK", 3)
    assert {r.node: r.root for r in components(simhash.link_fingerprints(df, 3)).collect()} == want
    assert len(want) > 100


def test_near_copies_go_and_clean_documents_stay(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    clean = [(k, " ".join(word() for _ in range(200))) for k in range(40)]
    copies = []
    for k in range(20):
        w = clean[k][1].split()
        w[rng.randrange(200)] = "changed"
        copies.append((100 + k, " ".join(w)))
    kept = simhash.keep_one(rows(spark, clean + copies))
    assert sorted(r.doc_id for r in kept.collect()) == [k for k, _ in clean]


def jaccard(a, b):
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) or {tuple(t.split())} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_links_are_verified(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    data, want, counts = [], [], {}
    for k, (at, low, high) in enumerate([(0.5, 0.49, 0.51), (0.65, 0.64, 0.66), (0.79, 0.785, 0.7999), (0.81, 0.8, 0.815)] * 12):
        base = [word() for _ in range(400)]
        while True:
            # a common beginning, then other words: the share of common shingles is near `at`
            n = round(404 * 2 * at / (1 + at)) - 4 + rng.randrange(-2, 3)
            copy = base[:n] + [word() for _ in range(400 - n)]
            if low <= jaccard(" ".join(base), " ".join(copy)) <= high:
                break
        data += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        want += [2 * k] if at > 0.8 else [2 * k, 2 * k + 1]
        counts[at] = counts.get(at, 0) + 1
    kept = {r.doc_id for r in simhash.keep_one(rows(spark, data)).collect()}
    assert kept == set(want) and len(counts) == 4


def test_repeats_count_once_in_near_links(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    one = [word() for _ in range(100)]
    again = one[:60] + one[:60] * 9 + one[60:]
    # a long repetition in common, and little else
    common = [word() for _ in range(10)] * 60
    apart = [[word() for _ in range(45)] + common for _ in range(2)]
    data = [(1, " ".join(one)), (2, " ".join(again)), (3, " ".join(one * 3)), (4, " ".join(apart[0])), (5, " ".join(apart[1]))]
    assert jaccard(data[0][1], data[1][1]) > 0.8 and jaccard(data[3][1], data[4][1]) < 0.3
    assert sorted(r.doc_id for r in simhash.keep_one(rows(spark, data)).collect()) == [1, 4, 5]


def test_near_links_of_short_texts(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    # four and five shingles, four of them in common: exactly 0.8; and six-word texts without a shingle in common
    pairs = [[word() for _ in range(9)] for _ in range(400)]
    data = [(2 * k + j, " ".join(w[: 8 + j])) for k, w in enumerate(pairs) for j in (0, 1)]
    data += [(1000 + k, " ".join(word() for _ in range(6))) for k in range(400)]
    kept = sorted(r.doc_id for r in simhash.keep_one(rows(spark, data)).collect())
    assert kept == [*range(0, 800, 2), *range(1000, 1400)]


def test_blocks_lose_no_link(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [[word() for _ in range(150)] for _ in range(3)]
    data = []
    for k in range(60):
        w = list(base[k % 3])
        w[rng.randrange(150)] = word()
        data.append((k, " ".join(w)))
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 3)
    assert sorted(r.doc_id for r in simhash.keep_one(rows(spark, data)).collect()) == [0, 1, 2]


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_decontaminate(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(rng.randrange(12, 40)))) for k in range(30)] + [(90, "too short"), (91, None)]
    text = lambda: [word() for _ in range(150)]
    docs, want = [(500, None), (501, ""), (502, "too short")], set()
    for k in range(30):
        w = items[k][1].split()
        if k % 3 == 1:
            w = [x.upper() + "," for x in w]
        if k % 3 == 2:
            w[len(w) // 2] = "edited"
            del w[len(w) // 3]
        docs.append((k, " ".join(text() + w + text())))
        want.add((k, k, 0 if k % 3 < 2 else 2))
    want.add((502, 90, 0))
    docs += [(100 + k, " ".join(text())) for k in range(30)]
    got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.matches(rows(spark, docs), bench(spark, items)).collect()}
    assert got == want
    clean = decontaminate.clean(rows(spark, docs), bench(spark, items))
    assert sorted(r.doc_id for r in clean.collect()) == [*range(100, 130), 500, 501]
    assert decontaminate.matches(rows(spark, []), bench(spark, items)).count() == 0
    assert decontaminate.clean(rows(spark, docs), bench(spark, [])).count() == len(docs)


def test_edit_distance_against_the_definition():
    rng = random.Random(4)
    for _ in range(200):
        item, text = [rng.randrange(4) for _ in range(rng.randrange(1, 7))], [rng.randrange(4) for _ in range(rng.randrange(0, 9))]
        best = len(item)
        for a in range(len(text) + 1):
            row = list(range(len(item) + 1))
            for x in text[a:]:
                new = [row[0] + 1]
                for k, w in enumerate(item):
                    new.append(min(row[k + 1] + 1, new[k] + 1, row[k] + (x != w)))
                row = new
                best = min(best, row[-1])
        got, begin, end = decontaminate.edit_distance(np.array(item, np.uint64), np.array(text, np.uint64))
        assert got == best and 0 <= begin <= end <= len(text)


def test_recall_at_the_most_edits():
    rng = random.Random(6)
    items = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(14, 40))) for _ in range(20)]
    search = decontaminate.Items(list(range(20)), items)
    found = 0
    for k, item in enumerate(items):
        w = item.split()
        for _ in range(int(decontaminate.EDITS * len(w))):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([["new"], [], [w[at], "more"]])
        off, seq = decontaminate.word_codes(pa.array([" ".join(["before"] * 50 + w + ["after"] * 50)]))
        found += any(i == k for _, i, *_ in search.search(off, seq))
    assert found >= 18


def edited(rng, item, n):
    w = item.split()
    for _ in range(int(decontaminate.EDITS * n)):
        at = rng.randrange(len(w))
        w[at : at + 1] = rng.choice([["new"], [], [w[at], "more"]])
    return w


def test_long_items_at_the_most_edits_are_found():
    rng = random.Random(12)
    for n in (60, 100, 200, 400):
        items = [" ".join(f"w{rng.randrange(2000)}" for _ in range(n)) for _ in range(20)]
        search = decontaminate.Items(list(range(20)), items)
        found = sum(d == i for d, i, *_ in search.search(*decontaminate.word_codes(pa.array([" ".join(["before"] * (n // 2) + edited(rng, item, n) + ["after"] * 50) for item in items]))))
        assert found == 20, (n, found)


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "four words right here"), (2, "Zephyr"), (3, "東京都は日本の首都である"), (4, "two words"), (5, "!!")]
    docs = [(1, "x Four words, right HERE y"), (2, "four words right now here"), (3, "a zephyr blows"), (4, "昔、東京都は日本の首都であると言った"), (5, "東京 は 首都"), (6, "two  words"), (7, "twowords"), (8, "!!"), (8, "two words")]
    got = sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.matches(rows(spark, docs), bench(spark, items)).collect())
    assert got == [(1, 1, 0), (3, 2, 0), (4, 3, 0), (6, 4, 0), (8, 4, 0)]


def test_clean_keeps_all_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 7, "x"), (2, None, None, None), (1, "other", 8, "y")], "doc_id long, text string, __found int, __lang string")
    clean = decontaminate.clean(docs, bench(spark, [(1, "a b c d e f")]))
    assert clean.columns == docs.columns and sorted(r["__found"] or 0 for r in clean.collect()) == [0, 8]
    long = rows(spark, [(1, "w " * 300_000 + "the passage of six words " * 3 + "v " * 300_000)])
    assert [(r.item_id, r.begin, r.edits) for r in decontaminate.matches(long, bench(spark, [(4, "the passage of six words the passage of six words")])).collect()] == [(4, 300_000, 0)]


def fewest_edits(item, text):
    best = len(item)
    for a in range(len(text) + 1):
        row = list(range(len(item) + 1))
        for x in text[a : a + 2 * len(item)]:
            new = [row[0] + 1]
            for k, w in enumerate(item):
                new.append(min(row[k + 1] + 1, new[k] + 1, row[k] + (x != w)))
            row = new
            best = min(best, row[-1])
    return best


def test_matches_against_brute_force(spark):
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(40)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 9, 10, 12, 15, 20])]
    docs = []
    for d in range(60):
        w = items[d % 12][1].split()
        for _ in range(rng.randrange(len(w) // 3 + 2)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[word()], [], [w[at], word()]]) or [word()]
        docs.append((d, " ".join([word() for _ in range(rng.randrange(12))] + w + [word() for _ in range(rng.randrange(12))])))
    want = {(d, i, e) for d, t in docs for i, x in items if (e := fewest_edits(x.split(), t.split())) <= int(decontaminate.EDITS * len(x.split()))}
    got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.matches(rows(spark, docs), bench(spark, items)).collect()}
    assert got == want and len({i for _, i, _ in want}) == 12


def test_recall_of_the_walks_alone(monkeypatch):
    monkeypatch.setattr(decontaminate.Items, "whole_pieces", lambda *a: iter(()))
    rng = random.Random(6)
    for n in (15, 20, 40, 60, 100, 200):
        items = [" ".join(f"w{rng.randrange(5000)}" for _ in range(n)) for _ in range(60)]
        search = decontaminate.Items(list(range(60)), items)
        found = sum(d == i for d, i, *_ in search.search(*decontaminate.word_codes(pa.array([" ".join(["before"] * n + edited(rng, item, n) + ["after"] * n) for item in items]))))
        assert found >= 54, (n, found)
