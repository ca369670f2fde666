import itertools
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewloom.llm.distinctive import distinctive_terms
from reviewloom.llm.encode import Encoder, encode_documents, tokenizer_path
from reviewloom.llm.frequency import mark_terms, merge_runs, term_frequencies
from reviewloom.llm.near_duplicates import (
    _likely,
    _packed,
    _pairs,
    _unpacked,
    band_keys,
    band_layout,
    bucket_pairs,
    components,
    dart_signatures,
    duplicate_groups,
    similar_links,
    similar_pairs,
)
from reviewloom.llm.packing import cut_shards, pack_documents
from reviewloom.llm.shared_spans import _link, repeated_units, shared_characters, shared_spans, span_pairs, without_repeats
from reviewloom.llm.top_items import top_items
from reviewloom.session import stash

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokenizer_path()), reason="no vocabulary file")


def toks(t):
    return [x.lower() for x in re.findall("[A-Za-z0-9]+", t or "")]


def words(rnd, n, size=400):
    return " ".join(f"w{rnd.randrange(size)}" for _ in range(n))


REVIEWS = [(1, "tea tea tea cup the"), (2, "the cup, THE saucer"), (3, None), (4, ""), (5, "tea the"), (6, "one"), (7, "é—!"), (8, "the " * 3000 + "end")]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(*r, 0, 0) for r in REVIEWS], "review_id bigint, text string, token int, n int")


# 2


def test_distinctive_terms(spark, small):
    n = len(REVIEWS)
    df = Counter(t for _, x in REVIEWS for t in set(toks(x)))
    want = {}
    for i, x in REVIEWS:
        t = toks(x)
        near = defaultdict(set)
        for a in range(len(t)):
            for b in range(a + 1, min(a + 4, len(t))):
                if t[a] != t[b]:
                    near[t[a]].add(t[b])
                    near[t[b]].add(t[a])
        for w, tf in Counter(t).items():
            want[i, w] = (tf, len(near[w]), df[w], len(near[w]) * math.log((n + 1) / df[w]))
    for hot in (1, 4, 65_536):  # none, some or all terms broadcast
        got = {(r.review_id, r.token): (r.tf, r.degree, r.df, r.score) for r in distinctive_terms(small, hot_terms=hot).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][:3] == want[k][:3] and got[k][3] == pytest.approx(want[k][3]) for k in want)
    assert distinctive_terms(small.limit(0)).count() == 0


# 5


def test_top_items(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), rnd.randint(1, 3), rnd.choice([0.0, 0.5]), i) for i in range(4000)]
    rows += rows[:300]  # second deliveries
    rows += [("lone", 1, 0.0, 9999), ("lone", 1, 0.0, 9999)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "product_id string, s int, h double, id bigint, _g0 string")
    for n in (1, 3, 50):
        for parts in (1, 7):
            got = defaultdict(list)
            out = top_items(df.repartition(parts), ["product_id"], [F.col("s"), F.col("h")], "id", n).select("product_id", "id").collect()
            for r in out:
                got[r.product_id].append(r.id)
            for k in {r[0] for r in rows}:
                best = sorted({r for r in rows if r[0] == k}, key=lambda r: (-r[1], -r[2], r[3]))[:n]
                assert sorted(got[k]) == sorted(r[3] for r in best)
    assert top_items(df.limit(0), ["product_id"], [F.col("s")], "id").count() == 0
    with pytest.raises(ValueError):
        top_items(df, ["product_id"], [F.col("s")], "id", 0)


def test_top_items_over_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame([("a" if i < 20 else "b", i % 5, i) for i in range(33)] * 2, "g string, s int, id bigint")
        got = sorted((r.g, r.id) for r in top_items(df, ["g"], [F.col("s")], "id", 4).collect())
        assert got == [("a", 4), ("a", 9), ("a", 14), ("a", 19), ("b", 23), ("b", 24), ("b", 28), ("b", 29)][:4] + [("b", 24), ("b", 28), ("b", 29), ("b", 23)][:0] + sorted([("b", 24), ("b", 29), ("b", 23), ("b", 28)])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# 7


def test_term_frequencies(spark, small):
    df, cf = Counter(), Counter()
    for _, x in REVIEWS:
        cf.update(toks(x))
        df.update(set(toks(x)))
    got = {r.token: (r.df, r.cf, r.mark) for r in mark_terms(term_frequencies(small), len(REVIEWS), 2, 0.3).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: (df[k], cf[k]) for k in df}
    assert got["the"][2] == "common" and got["saucer"][2] == "rare"
    assert term_frequencies(small.limit(0)).count() == 0


def test_merge_runs_over_small_batches(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", "cc", "d", None]), rnd.randint(1, 5), rnd.randint(1, 9)) for _ in range(500)] + [("zz", 1, 1)]
    want = defaultdict(lambda: [0, 0])
    for t, d, c in rows:
        if t:
            want[t][0] += d
            want[t][1] += c
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.token: [r.df, r.cf] for r in merge_runs(spark.createDataFrame(rows, "token string, df bigint, cf bigint")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == dict(want)


# 8


@needs_vocabulary
def test_tree_concatenation():
    enc = Encoder.load(tokenizer_path())
    rnd = random.Random(4)
    alphabet = ["a", "ab", "'", "'s", "'re", " ", "  ", "\n", "\n\n", "é", "日本", "1", "23", "!", "...", "the", "\t", " x", "ß", "\u200b", "🙂", "ll", "'l"]
    for k in range(1200):
        if k % 3 == 0:
            s = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 300)))
        elif k % 3 == 1:
            s = "".join(rnd.choice("abcdefghijklmnoprstuvwlying") for _ in range(rnd.randint(100, 2000)))
        else:
            s = "".join(rnd.choice(["a", "aa", "é", "ab", "日"]) for _ in range(rnd.randint(100, 1000)))
        leaf = max(rnd.choice([1, 2, 3, 7, 50, 130, 400]), len(s) // 200 + 1)
        got = enc.tree([enc.leaf(s[i : i + leaf]) for i in range(0, len(s), leaf)])
        assert got.ids.tolist() == enc.whole(s), (leaf, s)
        assert got.starts.tolist() == enc.leaf(s).starts.tolist()


@needs_vocabulary
def test_encode_documents(spark):
    rnd = random.Random(5)
    texts = ["", None, "hello  world", "<|endoftext|>", "x" * 3000, words(rnd, 900), "é" * 500, "日本語の" * 300, " \n\t ", "a\x00b"]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id bigint, text string, ids array<int>")
    enc = Encoder.load(tokenizer_path())
    for leaf in (64, 1000, 16_384):
        got = {r.doc_id: r.ids for r in encode_documents(df, leaf_chars=leaf).collect()}
        assert got == {i: enc.whole(t) if t else [] for i, t in enumerate(texts)}
    twice = df.unionAll(df)
    assert encode_documents(twice, leaf_chars=64).count() == 2 * len(texts)
    assert encode_documents(df.limit(0)).count() == 0


# 9


@needs_vocabulary
def test_packing(spark):
    rnd = random.Random(6)
    enc = Encoder.load(tokenizer_path())
    texts = [words(rnd, rnd.choice([3, 20, 60, 150]), 100) for _ in range(300)] + ["", None, words(rnd, 2000), "x y " * 5, "é"]
    exact = " a" * 128
    assert len(enc.whole(exact)) == 128
    texts += [exact, " a" * 64, " a" * 256]
    texts += [texts[0]] * 40
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, topic int")
    for shard in (50, 2048):
        out = pack_documents(df, capacity=128, shard_docs=shard).collect()
        room, parts = Counter(), defaultdict(list)
        for r in out:
            room[r.container_id] += r.n_tokens
            parts[r.doc_id].append(r)
        assert max(room.values()) <= 128
        assert set(parts) == set(range(len(texts)))
        for i, t in enumerate(texts):
            n = len(enc.whole(t)) if t else 0
            ps = sorted(parts[i], key=lambda r: r.part)
            assert [p.part for p in ps] == list(range(ps[0].parts)) and len(ps) == max(1, -(-n // 128))
            assert sum(p.n_tokens for p in ps) == n and [p.start for p in ps] == [128 * p.part for p in ps]
        total = sum(r.n_tokens for r in out)
        assert total / (128 * len([v for v in room.values() if v])) > 0.85
    assert pack_documents(df.limit(0)).count() == 0


def test_shards_cut_from_a_stream():
    for n in (0, 1, 9, 10, 14, 15, 16, 20, 47):
        for batch in (1, 7, 100):
            stream = (pa.record_batch([pa.array(range(i, min(n, i + batch)))], names=["x"]) for i in range(0, n, batch))
            shards = [[x for b in s for x in b.column(0).to_pylist()] for s in cut_shards(stream, 10)]
            assert [x for s in shards for x in s] == list(range(n))
            assert all(len(s) <= 15 and (len(s) >= 7 or len(shards) == 1) for s in shards)


@needs_vocabulary
def test_packing_keeps_topics_together(spark):
    rnd = random.Random(7)
    topic = lambda k: " ".join(f"t{k}x{rnd.randrange(30)}" for _ in range(12))
    df = spark.createDataFrame([(i, topic(i % 10)) for i in range(200)], "doc_id bigint, text string")
    boxes = defaultdict(list)
    for r in pack_documents(df, capacity=400).collect():
        boxes[r.container_id].append(r.doc_id % 10)
    same = [Counter(b).most_common(1)[0][1] / len(b) for b in boxes.values() if len(b) > 2]
    assert np.mean(same) > 0.6


# 6


def test_signatures_estimate_weighted_similarity():
    rnd = np.random.default_rng(8)
    k = 96
    for share in (0.2, 0.5, 0.8):
        n = 60
        both = int(2 * share * n / (1 + share))
        docs, xs, ws, want = [], [], [], []
        weight_of = {}
        for d in range(200):
            common = rnd.integers(1, 1 << 62, both)
            sets = [np.concatenate([common, rnd.integers(1, 1 << 62, n - both)]) for _ in range(2)]
            for x in np.unique(np.concatenate(sets)):
                weight_of[int(x)] = rnd.choice([0.05, 0.3, 0.6, 1.0])
            w = [sum(weight_of[int(x)] for x in s) for s in (common, *sets)]
            want.append(w[0] / (w[1] + w[2] - w[0]))
            for j, s in enumerate(sets):
                docs += [2 * d + j] * len(s)
                xs += s.tolist()
                ws += [weight_of[int(x)] for x in s]
        sig = dart_signatures(np.array(docs), np.array(xs, dtype=np.uint64), np.array(ws), 400, k)
        agree = (sig[0::2] == sig[1::2]).mean()
        assert (sig != 0).all()
        assert agree == pytest.approx(np.mean(want), abs=0.02)


def test_signatures_do_not_depend_on_the_batch():
    rnd = np.random.default_rng(9)
    doc = np.sort(rnd.integers(0, 300, 9000))
    doc = np.unique(doc, return_inverse=True)[1]
    x, w = rnd.integers(1, 1 << 62, len(doc)).astype(np.uint64), rnd.choice([0.05, 0.4, 1.0], len(doc))
    whole = dart_signatures(doc, x, w, doc.max() + 1, 40)
    for d in (0, 7, int(doc.max())):
        m = doc == d
        assert (dart_signatures(np.zeros(m.sum(), np.int64), x[m], w[m], 1, 40)[0] == whole[d]).all()
    big = dart_signatures(np.zeros(200_000, np.int64), rnd.integers(1, 1 << 62, 200_000).astype(np.uint64), np.ones(200_000), 1, 40)
    assert (big != 0).all()
    assert len(np.unique(band_keys(whole, band_layout(40, 15, 4)))) > 1


def jaccard(a, b):
    s, t = ({tuple(x[i : i + 3]) for i in range(len(x) - 2)} for x in (toks(a), toks(b)))
    return len(s & t) / max(1, len(s | t))


def test_similar_pairs(spark):
    rnd = random.Random(10)
    texts = []
    for _ in range(120):
        base = toks(words(rnd, rnd.randint(25, 60), 3000))
        texts.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 1, 3])):
            t = base[:]
            for _ in range(rnd.randint(0, 4)):
                t[rnd.randrange(len(t))] = f"n{rnd.random()}"
            texts.append(" ".join(t))
    texts += [texts[0]] * 50 + [None, "", "short one", "w " * 5000, "w " * 5001, words(rnd, 20_000, 9000)]
    rows = list(enumerate(texts))
    rows += rows[5:25]  # second deliveries
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "review_id bigint, text string, key int, rep int")
    links, members = similar_links(df)
    links = stash(links, "links")
    got = [(r.a, r.b) for r in similar_pairs(links, members, expand=1000).collect()]
    ok = [i for i, t in enumerate(texts) if len(toks(t)) >= 25]
    want = {(a, b) for a, b in itertools.combinations(ok, 2) if jaccard(texts[a], texts[b]) >= 0.5}
    assert len(got) == len(set(got))
    assert set(got) <= want
    assert len(want - set(got)) <= 0.02 * len(want)
    star = {(r.a, r.b) for r in similar_pairs(links, members, expand=8).collect()}
    assert star <= want
    linked = {i for p in want for i in p}
    assert {i for p in star for i in p} == {i for p in set(got) for i in p}
    groups = {r.id: r.group for r in duplicate_groups(links, members).collect()}
    assert set(groups) <= linked
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in got:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert groups == {i: find(i) for p in got for i in p}
    none = similar_links(df.limit(0))
    assert similar_pairs(*none).count() == 0 and duplicate_groups(*none).count() == 0


def test_similar_pairs_of_a_hot_template(spark):
    rnd = random.Random(14)
    template = words(rnd, 60, 3000)
    texts = [f"{template} " + " ".join(f"e{i}x{k}" for k in range(n)) for i, n in enumerate([20] * 150 + [8] * 150)]
    texts += [words(rnd, 40, 3000) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "review_id bigint, text string")
    got = {(r.a, r.b) for r in similar_pairs(*similar_links(df)).collect()}
    assert jaccard(texts[0], texts[1]) >= 0.55
    want = set(itertools.combinations(range(300), 2))
    assert got <= want and len(want - got) <= 0.02 * len(want), len(got)


def test_similar_pairs_of_many_spellings(spark):
    rnd = random.Random(15)
    base, other = words(rnd, 40, 3000), words(rnd, 40, 3000)
    texts = [base + "!" * i for i in range(36)] + [base + " again", base.upper()] + [other + "?"] * 3 + [other]
    df = spark.createDataFrame(list(enumerate(texts)), "review_id bigint, text string")
    links, members = similar_links(df)
    want = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if jaccard(texts[a], texts[b]) >= 0.5}
    links = stash(links, "links")
    for options in ({}, {"block": 5}):
        got = [(r.a, r.b) for r in similar_pairs(links, members, **options).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_bucket_pairs(spark):
    rnd = random.Random(11)
    rows = [(rnd.randint(0, 40), i) for i in range(150)] + [(99, i) for i in range(500)] + [(98, 3), (98, 3)]
    by = defaultdict(set)
    for k, i in rows:
        by[k].add(i)
    want = {p for s in by.values() for p in itertools.combinations(sorted(s), 2)}
    df = spark.createDataFrame(rows, "key bigint, id bigint")
    for batch in ("5", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            for block in (4, 60, 1000):
                got = [tuple(r) for r in bucket_pairs(df, len(rows), block).collect()]
                assert len(got) == len(set(got)) and set(got) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_large_buckets_stay_bounded():
    sizes = {1: 3, 2: 20_000, 3: 1, 4: 256, 5: 257, 6: 20_000}
    key = np.repeat(list(sizes), list(sizes.values()))
    ids = np.arange(len(key))
    for batch in (100, 257, 10_000, 1 << 20):
        rows = [pa.record_batch([pa.array(key[i : i + batch]), pa.array(ids[i : i + batch])], names=["key", "id"]) for i in range(0, len(key), batch)]
        alone, pairs = defaultdict(list), defaultdict(set)
        for b in _pairs(256)(rows):
            assert b.num_rows <= max(batch + 256, 256 * 256)
            for x, y, k in zip(*(c.to_pylist() for c in b.columns)):
                alone[k].append(x) if y is None else pairs[k].add((x, y))
        for k, n in sizes.items():
            of = ids[key == k].tolist()
            assert sorted(alone[k]) == (of if n > 256 else [])
            assert pairs[k] == (set(itertools.combinations(of, 2)) if n <= 256 else set())


def test_packed_rows_come_back():
    rnd = np.random.default_rng(16)
    for top in (10, 300, 70_000, 1 << 40):
        key, ids = rnd.integers(-(1 << 63), 1 << 63, 900), rnd.integers(-5, top, 900)
        key[:300] = key[300:600]
        rows = [pa.record_batch([pa.array(key[i : i + 250]), pa.array(ids[i : i + 250])], names=["key", "id"]) for i in range(0, 900, 250)]
        packed = [b for b in _packed(3)(rows)]
        low = (key.view(np.uint64) & np.uint64((1 << 40) - 1)).astype(np.int64)
        part = ((key.view(np.uint64) >> np.uint64(40)) * np.uint64(3) >> np.uint64(24)).astype(int)
        for p in range(3):
            of = [b.filter(pa.array(np.asarray(b.column(0)) == p)) for b in packed]
            every = sorted(zip(low[part == p].tolist(), ids[part == p].tolist()))
            twice = set(low[:300].tolist())
            for hold, want in ((10, every), (10_000, [x for x in every if x[0] in twice])):
                got = [(k, i) for b in _unpacked(hold)(of) for k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
                assert sorted(got) == want


def test_likely_pairs_lose_none():
    rnd = np.random.default_rng(17)
    rows = []
    for share in np.linspace(0, 1, 60):
        both = rnd.integers(0, 1 << 62, int(40 * share))
        a, b = (np.unique(np.concatenate([both, rnd.integers(0, 1 << 62, rnd.integers(1, 40))])) for _ in range(2))
        rows.append((a, b, len(np.intersect1d(a, b)) / len(np.union1d(a, b))))
    short = lambda x: np.sort((x & 0xFFFF).astype(np.uint16)).tobytes()
    n = range(len(rows))
    batch = pa.record_batch([pa.array(n), pa.array(n), pa.array([short(r[0]) for r in rows]), pa.array([short(r[1]) for r in rows])], names=["a", "b", "ra", "rb"])
    for at in (0, 7):
        got = {x for b in _likely(0.5)([batch.slice(at)]) for x in b.column(0).to_pylist()}
        want = {i for i in n if i >= at and rows[i][2] >= 0.5}
        assert want <= got and len(got) <= len(want) + 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (300, 200), (5, 5)]
    got = {r.node: r.group for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100, 300: 100}


# 10


def shares(x, y, n=200):
    s = {x[i : i + n] for i in range(len(x) - n + 1)}
    return any(y[i : i + n] in s for i in range(len(y) - n + 1))


@pytest.fixture(scope="module")
def span_docs():
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choice("abcdefghijé日") for _ in range(rnd.randint(2, 7))) for _ in range(500)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    common, base = text(40)[:140], [text(120) for _ in range(15)]
    out = []
    for i in range(110):
        t = text(60)
        if i % 2:
            t += " " + common + " " + text(40)
        if i % 5 == 0:
            a = rnd.randint(0, 300)
            t = t[:100] + rnd.choice(base)[a : a + rnd.randint(195, 320)] + t[100:]
        if i % 17 == 0:
            t += "ha " * rnd.randint(50, 200)
        out.append(t)
    out += [out[0], out[0], None, "", "x" * 199, "y" * 200, "y" * 450, base[0][:200], "z" + base[0][1:199] + "z"]
    return out


def test_shared_spans(spark, span_docs):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(span_docs)], "doc_id bigint, text string, digest int")
    ok = [i for i, t in enumerate(span_docs) if t]
    want = {(a, b) for a, b in itertools.combinations(ok, 2) if shares(span_docs[a], span_docs[b])}
    for expand in (64, 20):  # the common unit is looked at in place, or in the runs around it
        spans, members = shared_spans(df, expand=expand)
        spans = stash(spans, "spans")
        assert {(r.a, r.b) for r in span_pairs(spans, members).collect()} == want
    for r in spans.collect():
        x, y = span_docs[r.a], span_docs[r.b]
        assert r.chars >= 200 and x[r.at_a : r.at_a + r.chars] == y[r.at_b : r.at_b + r.chars]
        assert r.at_a == 0 or r.at_b == 0 or x[r.at_a - 1] != y[r.at_b - 1]
    got = {r.doc_id: (r.n_chars, r.shared_chars) for r in shared_characters(df, spans, members).collect()}
    assert len(got) == len(span_docs)
    for i, t in enumerate(span_docs):
        if t is None:
            assert got[i] == (None, None)
            continue
        mask = np.zeros(len(t), dtype=bool)
        others = [o for j, o in enumerate(span_docs) if o and j != i]
        runs = {o[k : k + 200] for o in others for k in range(len(o) - 199)} if any((i in p) for p in want) else set()
        for k in range(len(t) - 199):
            if t[k : k + 200] in runs:
                mask[k : k + 200] = True
        assert got[i] == (len(t), int(mask.sum())), i
    none = shared_spans(df.limit(0))
    assert span_pairs(*none).count() == 0


def test_span_in_many_documents(spark):
    rnd = random.Random(13)
    notice = words(rnd, 60)[:230]
    texts = [f"{i} {words(rnd, 20 + i % 7)} {notice} {words(rnd, 20)} {i}" for i in range(70)] + [f"{i} {words(rnd, 60)}" for i in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = set(itertools.combinations(range(70), 2))
    for options in ({}, {"expand": 20, "block": 16}):
        spans, members = shared_spans(df, **options)
        got = [tuple(r) for r in spans.select("a", "b", "at_a", "at_b", "chars").collect()]
        assert len(got) == len(set(got)) and {g[:2] for g in got} == want
        assert {(r.a, r.b) for r in span_pairs(stash(spans, "spans"), members).collect()} == want


def test_shared_characters_of_a_repeated_span(spark):
    rnd = random.Random(16)
    notice = words(rnd, 60)[:230]
    texts = [f"a {notice} b {words(rnd, 20)} c {notice} d"] + [f"{i}a {words(rnd, 20)} {notice} {i}d" for i in range(1, 70)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans, members = shared_spans(df, every=False)
    got = {r.doc_id: r.shared_chars for r in shared_characters(df, stash(spans, "spans"), members).collect()}
    other = [x for t in texts[1:] for x in (t[i : i + 200] for i in range(len(t) - 199))]
    runs, mask = set(other), np.zeros(len(texts[0]), dtype=bool)
    for k in range(len(texts[0]) - 199):
        if texts[0][k : k + 200] in runs:
            mask[k : k + 200] = True
    assert got[0] == int(mask.sum()) >= 460 and min(got.values()) >= 230


def test_link_waits_for_another_document():
    import pyarrow as pa

    rows = [(7, 1, k) for k in range(40)] + [(7, 2, 5), (7, 2, 9), (7, 3, 0)]
    batch = pa.record_batch([pa.array(c) for c in zip(*rows)], names=["digest", "id", "at"])
    for step in (1, 20, 100):
        out = _link(2, True)(batch.slice(k, step) for k in range(0, len(rows), step))
        got = [x for b in out for x in zip(*(b.column(c).to_pylist() for c in range(4)))]
        assert sorted(got) == sorted([(1, 2, k, 5) for k in range(1, 40)] + [(1, 2, 0, 5), (1, 2, 0, 9), (1, 3, 0, 0)])


def test_spans_repeated_in_few_documents(spark):
    rnd = random.Random(17)
    line = words(rnd, 80)[:249] + "\n"
    df = spark.createDataFrame([(i, f"{i} {words(rnd, 20)} " + line * 100 + f"{i}") for i in range(12)], "doc_id bigint, text string")
    spans, members = shared_spans(df)
    pairs = span_pairs(stash(spans.select("a", "b").distinct(), "spans"), members)
    assert {(r.a, r.b) for r in pairs.collect()} == set(itertools.combinations(range(12), 2))


def test_spans_at_many_uneven_places(spark):
    rnd = random.Random(19)
    line = words(rnd, 70, 3000)[:250]
    texts = ["".join(line + words(rnd, 30, 3000)[: rnd.randint(5, 90)] for _ in range(n)) for n in (150, 150, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans, members = shared_spans(df, one=True)
    assert {(r.a, r.b) for r in span_pairs(stash(spans.select("a", "b").distinct(), "spans"), members).collect()} == {(0, 1), (0, 2), (1, 2)}
    spans, members = shared_spans(df, every=False)
    got = {r.doc_id: r.shared_chars for r in shared_characters(df, stash(spans, "spans"), members).collect()}
    # a stretch may go on by characters that happen to be equal
    for i, n in enumerate((150, 150, 3)):
        assert 250 * n <= got[i] <= 260 * n


def test_hot_digests_are_split(spark, span_docs, hot=30):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(span_docs) if i < 40], "doc_id bigint, text string")
    for options in ({}, {"every": False}):
        want = shared_spans(df, expand=3, **options)
        got = shared_spans(df, expand=3, hot=hot, **options)
        if options:
            n = [{r.doc_id: r.shared_chars for r in shared_characters(df, stash(x[0], "spans"), x[1]).collect()} for x in (got, want)]
        else:
            n = [{tuple(r) for r in x[0].collect()} for x in (got, want)]
        assert n[0] == n[1] and n[0]


def test_repeated_units(spark):
    docs = [(1, "One  para.\n\nTwo\n\nOne para."), (2, "x\n\nTWO \n\n\n\ny"), (3, None), (4, ""), (5, "one para.")]
    df = spark.createDataFrame(docs, "id bigint, text string")
    got = sorted((r.id, r["at"], r.keep_id, r.keep_at) for r in repeated_units(df).collect())
    assert got == [(1, 17, 1, 0), (2, 3, 1, 12), (5, 0, 1, 0)]
    assert repeated_units(df.limit(0)).count() == 0
    lines = spark.createDataFrame([(1, "a\nb\na")], "id bigint, text string")
    assert [(r["at"], r.keep_at) for r in repeated_units(lines, "line").collect()] == [(4, 0)]
    clean = {r.id: (r.text, r.kept and [tuple(k) for k in r.kept]) for r in without_repeats(df).collect()}
    assert clean == {1: ("One  para.\n\nTwo", [(0, 10), (12, 3)]), 2: ("x\n\n\n\ny", [(0, 1), (9, 0), (11, 1)]), 3: (None, None), 4: ("", [(0, 0)]), 5: ("", [])}
    original = dict(docs)
    for i, (t, kept) in clean.items():
        assert t is None or t == "\n\n".join(original[i][a : a + n] for a, n in kept)
