import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.functions import codecs
from reviewloom.functions.tokens import tokens
from reviewloom.operators import build, lookup, rank
from reviewloom.operators.reviews import current_reviews
from reviewloom.sources import dump, index

GOLDEN = """
0 10x 1 1 1,1 88 0 - 10x 0
1 bad 1 1 2,1 98 1 0 bad -
2 best 1 1 3,1 A400 2 1 est -
3 better 1 1 1,1 88 4 2 tter -
4 coffee 2 3 1,1,3,2 8899 5 0 coffee -
5 good 2 3 1,2,3,1 8998 7 0 good -
6 it 1 1 5,1 B400 9 0 it -
7 more 1 1 5,1 B400 11 0 more -
8 not 1 1 3,1 A400 13 - not 29
9 s 1 1 5,1 B400 15 0 s -
10 tea 2 4 1,1,5,3 88AD00 17 0 tea -
11 the 1 1 3,1 A400 20 1 he -
12 very 1 1 1,1 88 22 0 very -
"""
ROWS = [x.split() for x in GOLDEN.strip().split("\n")]


@pytest.fixture(scope="module")
def post(mini):
    return build.postings(mini).cache()


def rows(df, *by):
    return sorted(tuple(r) for r in df.collect())


def test_tokenizer(spark):
    texts = ["aKb K", None, "", "--", "It's 10x", "Ärger é1", "a" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(tokens("t").alias("x"))
    assert [r.x for r in df.collect()] == [["a", "b", "k"], [], [], [], ["it", "s", "10x"], ["rger", "1"], ["a" * 5000]]


def test_arrow_tokenizer_agrees(spark):
    import pyarrow as pa

    from reviewloom.functions.arrow_tokens import tokenize_batch

    texts = ["aKb K", None, "", "--", "It's 10x", "日本 tea", "X"]
    row, toks = tokenize_batch(pa.array(texts, pa.string()))
    got = [[] for _ in texts]
    for r, t in zip(row.tolist(), toks.to_pylist()):
        got[r].append(t)
    want = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tokens("t").alias("x")).collect()]
    assert got == want
    row, toks = tokenize_batch(pa.array(["skip", "Ab c", None]).slice(1))
    assert (row.tolist(), toks.to_pylist()) == ([0, 0], ["ab", "c"])
    assert tokenize_batch(pa.array([], pa.string()))[0].tolist() == []


def test_dictionary_and_postings(mini, post):
    assert rows(build.token_stats_of(mini)) == rows(build.token_stats(post))
    d = build.token_dictionary(build.token_stats(post)).collect()
    assert sorted((str(r.token_num), r.token, str(r.df), str(r.cf)) for r in d) == sorted(tuple(x[:4]) for x in ROWS)
    assert all(r.token_length == len(r.token) for r in d)
    assert {(r.token, r.postings) for r in build.postings_flat(post).collect()} == {(x[1], x[4]) for x in ROWS}


def test_gaps(spark):
    p = spark.createDataFrame([("a", i, 1) for i in (40, 45, 60, 70_000, 200_000)], "token string, review_id bigint, tf bigint")
    g = build.postings_gaps(p)
    assert [r.gap for r in g.orderBy("review_id").collect()] == [40, 5, 15, 69_940, 130_000]
    lists = build.gap_lists(g)
    assert lists.count() == 3 and "review_id" not in lists.schema.simpleString()
    back = build.gaps_to_ids(lists)
    assert sorted(r.review_id for r in back.collect()) == [40, 45, 60, 70_000, 200_000]


def test_bytes_and_offsets(post):
    coded = codecs.delta_coded_postings(build.postings_gaps(post))
    assert {(r.token, r.hex) for r in coded.collect()} == {(x[1], x[5]) for x in ROWS}
    assert {(r.token, str(r.byte_offset)) for r in build.byte_offsets(coded).collect()} == {(x[1], x[6]) for x in ROWS}


def test_front_coding(post):
    d = build.token_dictionary(build.token_stats(post))
    got = {(r.token_num, "-" if r.prefix_len is None else str(r.prefix_len), r.suffix, "-" if r.pointer is None else str(r.pointer)) for r in codecs.front_coding(d).collect()}
    assert got == {(int(x[0]), x[7], x[8], x[9]) for x in ROWS}


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 16])
def test_front_coding_sizes(spark, n):
    words = sorted({f"w{i:02d}x" * (1 + i % 3) for i in range(n)})
    d = spark.createDataFrame(list(enumerate(words)), "token_num bigint, token string")
    back = codecs.front_decoding(codecs.front_coding(d))
    assert rows(back) == list(enumerate(words))
    probes = spark.createDataFrame([(w,) for w in [*words, "zz"]], "probe string")
    found = {r.probe: r.token_num for r in lookup.token_numbers(probes, d).collect()}
    assert found == {**{w: i for i, w in enumerate(words)}, "zz": -1}


def test_stats_and_tables(mini, post):
    s = build.corpus_stats(mini, build.token_stats_of(mini)).collect()
    assert [tuple(r) for r in s] == [(5, 20, 13, 3)]
    assert [r.length for r in mini.orderBy("review_id").collect()] == [7, 1, 6, 0, 6]
    assert [r.score for r in mini.orderBy("review_id").collect()] == [5, 4, 1, 3, 2]
    p = build.products(mini).orderBy("product_num").collect()
    assert [(r.product_num, r.product_id, r.first_review_id, r.span_length) for r in p] == [(0, "B000000001", 1, 1), (1, "B000000002", 3, 0), (2, "B000000003", 4, 1)]


def test_empty_tables(spark, mini):
    e = mini.limit(0)
    post = build.postings(e)
    assert build.token_dictionary(build.token_stats(post)).count() == 0
    assert [tuple(r) for r in build.corpus_stats(e, build.token_stats_of(e)).collect()] == [(0, 0, 0, 0)]
    assert build.products(e).count() == 0
    assert codecs.front_coding(build.token_dictionary(build.token_stats(post))).count() == 0
    assert rank.vector_space_search("good", post, build.token_stats(post), 0).count() == 0


def test_ranges_of_a_scattered_product(spark):
    r = spark.createDataFrame([(i, "AbC1" if i % 2 else "toolongidentifier") for i in range(1, 6)], "review_id bigint, product_id string")
    probe = spark.createDataFrame([("AbC1",), ("abc1",)], "probe string")
    assert rows(lookup.product_reviews(probe, r)) == [("AbC1", 1), ("AbC1", 3), ("AbC1", 5)]
    assert rows(lookup.product_reviews_range(probe, build.product_spans(r))) == [("AbC1", 1), ("AbC1", 2), ("AbC1", 3)]
    ten = spark.createDataFrame([("p", 10, 2)], "product_id string, first_review_id bigint, span_length bigint")
    assert rows(lookup.product_reviews_range(spark.createDataFrame([("p",)], "probe string"), ten)) == [("p", 10), ("p", 11), ("p", 12)]


def test_current_reviews(spark):
    t = [(1, "a", "2024-01-01"), (1, "a", "2024-02-01"), (2, None, "2024-01-01"), (None, "x", "2024-01-01"), (2, None, "2024-01-01")]
    df = spark.createDataFrame([(*x, 0) for x in t], "review_id bigint, text string, loaded_at string, _n int")
    for repeated in (10, 1, 0):
        assert rows(current_reviews(df, "text", repeated=repeated)) == [(1, "a"), (2, None)]
    # three deliveries, an unknown time, a clashing name
    t = [(3, "c", f"2024-01-0{k}") for k in (3, 1, 2)] + [(4, "d", None), (4, "d", "2024-01-01"), (5, "e", None), (6, "f", "2024-01-02")]
    df = spark.createDataFrame(t, "review_id bigint, last string, loaded_at string")
    want = [(3, "c", "2024-01-01"), (4, "d", None), (5, "e", None), (6, "f", "2024-01-02")]
    for repeated in (10, 0):
        assert rows(current_reviews(df, "last", "loaded_at", repeated=repeated)) == want
    assert rows(current_reviews(df.limit(0), "last")) == []


def test_codec_goldens(spark):
    n = spark.range(1).select(*[codecs.gamma(F.lit(i)).alias(f"g{i}") for i in (0, 1, 2, 7)], *[codecs.delta(F.lit(i)).alias(f"d{i}") for i in (40, 3, 5, 2, 15, 1)]).collect()[0]
    assert list(n) == ["0", "100", "101", "1110000", "1101001001", "10100", "10110", "1001", "110010000", "1000"]
    for four, h in (([0, 3, 4, 7], "0000030407"), ([300, 1, 2, 6], "40012C010206"), ([256, 1, 2, 6], "400100010206")):
        assert spark.range(1).select(F.hex(codecs.group_varint(*[F.lit(x) for x in four]))).head()[0] == h
    packed = spark.createDataFrame([("110100100110100101101001110010000" "1000",)], "b string").select(F.hex(codecs.pack_bits("b"))).head()[0]
    assert packed == "D26969C840"


def test_codec_round_trips(spark):
    values = sorted({0, 1, 256, 65536, 65541, 1 << 24, (1 << 31) - 2, *[(1 << k) - 1 for k in range(31)], *[1 << k for k in range(31)]})
    df = spark.createDataFrame([(v,) for v in values], "n bigint")
    bits = df.select("n", F.concat(codecs.gamma("n"), codecs.gamma(F.lit(0))).alias("g"), F.concat(F.lit("0"), codecs.delta("n")).alias("d"))
    back = bits.select(
        "n",
        codecs.gamma_decode(codecs.unpack_bits(codecs.pack_bits("g")), F.lit(2)).alias("g"),
        codecs.delta_decode(codecs.unpack_bits(codecs.pack_bits("d")), F.lit(2)).alias("d"),
    )
    for r in back.collect():
        assert r.g == [r.n, 0]
        assert r.d == [0, r.n]
    v = df.select("n", codecs.group_varint_decode(codecs.group_varint("n", F.lit(0), "n", F.lit(65541))).alias("v"))
    for r in v.collect():
        assert tuple(r.v) == (r.n, 0, r.n, 65541)
    assert spark.createDataFrame([("",)], "b string").select(codecs.unpack_bits(codecs.pack_bits("b")).alias("x")).head().x == ""


def test_decoding_is_linear_and_checked():
    rnd = np.random.default_rng(3)
    values = [rnd.integers(0, 1 << int(rnd.integers(1, 40)), n) for n in (0, 1, 300, 70_000, 2)]

    def gamma(n):
        b = bin(n + 1)[2:]
        return "1" * (len(b) - 1) + "0" + b[1:]

    def delta(n):
        b = bin(n + 1)[2:]
        return gamma(len(b) - 1) + b[1:]

    for kind, f in (("gamma", gamma), ("delta", delta)):
        rows = ["".join(f(int(v)) for v in x) for x in values]
        bits = np.frombuffer("".join(rows).encode(), dtype=np.uint8) - ord("0")
        row, got = codecs.decode_bits(bits, np.cumsum([len(r) for r in rows]), np.full(5, 1 << 62), kind)
        assert (row == np.repeat(range(5), [len(x) for x in values])).all() and (got == np.concatenate(values)).all()
        for broken in ("1", "110", "0111"):
            with pytest.raises(ValueError):
                codecs.decode_bits(np.array(list(map(int, broken))), np.array([len(broken)]), np.array([9]), kind)
        assert len(codecs.decode_bits(np.zeros(0, np.uint8), np.array([0]), np.array([9]), kind)[1]) == 0


def test_postings_of_many_segments_come_back(spark):
    p = spark.createDataFrame([(t, i, 1 + i % 3) for t in ("a", "b") for i in (1, 2, 40, 65_535, 65_536, 70_000, 200_000)], "token string, review_id bigint, tf bigint")
    assert rows(codecs.decoded_postings(codecs.coded_segments(build.postings_gaps(p)))) == rows(p)
    nulls = spark.createDataFrame([("10100", None), (None, 1), ("", 3)], "b string, n int").select(codecs.gamma_decode("b", F.col("n")).alias("v"))
    assert [r.v for r in nulls.collect()] == [[2, 0, 0], None, []]
    packed = spark.createDataFrame([("10100",)], "b string").select(codecs.gamma_decode(codecs.pack_bits("b"), F.lit(2)).alias("v"))
    assert packed.head().v == [2, 0]


def test_stored_review_rows(spark):
    df = spark.createDataFrame([(1, 70_000, 1 << 24, 256, 0, 5), (2, None, None, 0, 3, None)], "id int, p bigint, a int, b int, n bigint, score int")
    packed = df.select("id", codecs.review_row("p", "a", "b", "n", "score").alias("r"))
    assert rows(packed.select("id", codecs.review_row_decode("r").alias("r")).select("id", "r.v.*", "r.score")) == [(1, 70_000, 1 << 24, 256, 0, 5), (2, 0, 0, 0, 3, 0)]


def test_flat_slices(spark):
    df = spark.createDataFrame([([40, 3, 45, 2, 60, 1],)], "a array<int>")
    assert list(df.select(build.flat_part(F.col("a"), "ids"), build.flat_part(F.col("a"), "frequencies")).head()) == [[40, 45, 60], [3, 2, 1]]


def test_ranking(spark, mini, post):
    w = rank.review_weights(mini)
    got = {r.review_id: round(r.weight, 6) for r in w.collect()}
    assert got == {1: 0.875, 2: 0.071429, 3: 0.75, 4: 0.0, 5: 1.0}
    hits = rank.vector_space_search("good coffee", post, build.token_stats(post), 5)
    assert [(r.review_id, round(r.score, 6), r["rank"]) for r in hits.orderBy("rank").collect()] == [(1, 1.627074, 1), (3, 1.627074, 2)]
    q = rank.product_quality(mini)
    assert {r.product_id: round(r.quality, 6) for r in q.collect()} == {"B000000001": 2.560159, "B000000002": 0.519860, "B000000003": 1.098612}
    ranked = rank.product_rank(rank.product_relevance(hits, w), q)
    top = rank.product_search(ranked).collect()
    assert [(r.product_id, round(r.rank_value, 6)) for r in top] == [("B000000001", 3.830548), ("B000000002", 1.468458)]
    by = {}
    for r in w.collect():
        by.setdefault(r.product_id, []).append((r.weight, r.score))
    want = {"sum": lambda v: sum(a * b for a, b in v), "weighted_mean": lambda v: sum(a * b for a, b in v) / sum(a for a, _ in v)}
    for how, f in want.items():
        got = {r.product_id: r.quality for r in rank.product_quality(mini, rank.RankParams(quality=how)).collect()}
        assert got == {k: pytest.approx(f(v) * math.log(len(v) + 1)) for k, v in by.items()}
    assert rank.vector_space_search("zzz", post, build.token_stats(post), 5).count() == 0


DUMP = """junk before
product/productId: B000000001
review/userId: A1
review/helpfulness: 3/4
review/score: 5.0
review/text: Good: very GOOD tea/coffee, 10x better

product/productId: AB12
product/title: thing
review/helpfulness: 0/0
review/score: 4.5
review/text: see product/productId: X and review/score: 1.0
two lines

product/productId: B000000003
review/helpfulness: 0/0
review/text: no score
"""


def test_dump(spark, tmp_path):
    p = tmp_path / "dump.txt"
    p.write_text(DUMP[12:])
    good, bad = dump.read_dump(spark, str(p))
    g = {r.review_id: r for r in good.collect()}
    assert [g[i].product_id for i in (1, 2)] == ["B000000001", "AB12"]
    assert g[2].text == "see product/productId: X and review/score: 1.0\ntwo lines"
    assert (g[2].score, g[2].helpfulness) == ("4.5", "0/0")
    assert [r.reason for r in bad.collect()] == ["missing score"]
    fused, _ = dump.read_dump(spark, str(p), join_lines="")
    assert "1.0two lines" in {r.review_id: r.text for r in fused.collect()}[2]
    p.write_text(DUMP)
    assert dump.read_dump(spark, str(p))[0].count() == 2
    p.write_text("")
    good, bad = dump.read_dump(spark, str(p))
    assert (good.count(), bad.count()) == (0, 0)


def test_dump_of_many_files(spark, tmp_path):
    n, lines = 0, 3
    for k in range(7):
        recs = []
        for _ in range(3 + 40 * (k % 3)):
            n += 1
            recs.append(f"product/productId: P{n}\nreview/helpfulness: 0/0\nreview/score: 1\nreview/text: " + "x\n" * lines)
        (tmp_path / f"part{k}.txt").write_text("junk\n" * (k % 2) + "\n".join(recs))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        good, bad = dump.read_dump(spark, str(tmp_path))
        assert [(r.review_id, r.product_id) for r in good.orderBy("review_id").collect()] == [(i, f"P{i}") for i in range(1, n + 1)]
        assert bad.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_persisted_index(spark, mini, tmp_path):
    path = str(tmp_path / "index")
    index.write_index(mini.select("review_id", "product_id", "score", "helpfulness_num", "helpfulness_denom", "text"), path)
    r = index.open_index(spark, path)
    assert r.product_id(3) == "B000000002" and r.product_id(0) is None and r.product_id(6) is None
    assert [r.review_score(i) for i in (-1, 0, 1, 5, 6)] == [-1, -1, 5, 2, -1]
    assert (r.review_helpfulness_numerator(1), r.review_helpfulness_denominator(1), r.review_length(1)) == (3, 4, 7)
    assert (r.token_frequency("TEA"), r.token_collection_frequency("tea"), r.token_frequency("tea/coffee")) == (2, 4, 0)
    assert [tuple(x) for x in r.reviews_with_token("Tea").collect()] == [(1, 1), (5, 3)]
    assert r.reviews_with_token("none").count() == 0
    assert (r.number_of_reviews(), r.token_size_of_reviews()) == (5, 20)
    assert [x.review_id for x in r.product_reviews("B000000003").collect()] == [4, 5]
    assert r.product_reviews("b000000003").count() == 0
    assert index.drop_index(spark, path)
    assert not index.drop_index(spark, path)


def test_build_with_a_small_heap(tmp_path):
    """Sorts and aggregates spill; a review table several times the execution memory is built."""
    code = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from reviewloom.session import ensure_package
from reviewloom.sources.index import open_index, write_index
s = SparkSession.builder.master("local[2]").config("spark.driver.memory", "512m").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
ensure_package(s)
word = lambda x: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", x), F.lit(5000)))
r = s.range(1, 40001).select(F.col("id").alias("review_id"), F.concat(F.lit("p"), F.col("id") % 7).alias("product_id"), *[F.lit(1).alias(c) for c in ("score", "helpfulness_num", "helpfulness_denom")], F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), word)).alias("text"))
write_index(r, {path!r})
x = open_index(s, {path!r})
print("built", x.number_of_reviews(), x.token_size_of_reviews(), x.postings.agg(F.sum("tf")).head()[0])
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))}
    done = subprocess.run([sys.executable, "-c", code.format(root=root, path=str(tmp_path / "index"))], capture_output=True, text=True, env=env, timeout=600)
    assert "built 40000 2400000 2400000" in done.stdout, done.stderr[-2000:]


def test_batch_lookups(spark, mini, post):
    ids = spark.createDataFrame([(i,) for i in (-1, 0, 1, 5, 6)], "probe bigint")
    a = {r.probe: tuple(r)[1:] for r in lookup.review_attributes(ids, mini).collect()}
    assert a[1] == (5, 3, 4, 7) and a[0] == a[-1] == a[6] == (-1, -1, -1, -1)
    assert {r.probe: r.product_id for r in lookup.review_products(ids, mini).collect()}[6] is None
    t = spark.createDataFrame([("TEA",), ("zz",), ("tea/coffee",)], "probe string")
    assert rows(lookup.token_frequencies(t, build.token_stats(post))) == [("TEA", 2, 4), ("tea/coffee", 0, 0), ("zz", 0, 0)]
    assert rows(lookup.token_postings(t, post)) == [("TEA", 1, 1), ("TEA", 5, 3)]


def test_long_review(spark):
    r = spark.createDataFrame([(1, " ".join(["w"] * 256))], "review_id bigint, text string")
    assert build.review_lengths(r).head().length == 256
    assert tuple(build.postings(r).head()) == ("w", 1, 256)
