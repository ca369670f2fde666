import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewloom.operators.error_parse import CSV_FIELDS, cheapest_edits, loaded, parse_raw, read_csv, rejected
from reviewloom.operators.key_profile import hot_keys, key_profile, keyed_lists
from reviewloom.operators.term_counts import tf_histogram


def fields_of(raw):
    """Plain reader of the csv rules; None if the quotes break them."""
    out, i = [], 0
    while True:
        if raw[i : i + 1] == '"':
            j, v = i + 1, ""
            while True:
                if j >= len(raw):
                    return None
                if raw[j] == '"':
                    if raw[j + 1 : j + 2] == '"':
                        v += '"'
                        j += 2
                        continue
                    break
                v += raw[j]
                j += 1
            i = j + 1
            if i < len(raw) and raw[i] != ",":
                return None
        else:
            j = raw.find(",", i)
            j = len(raw) if j < 0 else j
            v, i = raw[i:j], j
        out.append(v)
        if i >= len(raw):
            return out
        i += 1


def brute_cost(raw, fields):
    """Fewest insertions and deletions of quotes and commas, by trying all."""
    seen, level, cost = {raw}, {raw}, 0
    while True:
        for s in level:
            f = fields_of(s)
            if f is not None and (fields is None or len(f) == fields):
                return cost
        nxt = set()
        for s in level:
            for i in range(len(s) + 1):
                nxt |= {s[:i] + c + s[i:] for c in '",'}
                if i < len(s) and s[i] in '",':
                    nxt.add(s[:i] + s[i + 1 :])
        level = nxt - seen
        seen |= level
        cost += 1


def test_cheapest_edits_against_brute_force():
    for n in range(5):
        for t in itertools.product('a",', repeat=n):
            raw = "".join(t)
            for fields in (None, 1, 2, 3):
                assert len(cheapest_edits(raw, fields)) == brute_cost(raw, fields), (raw, fields)


def test_csv_reader_against_plain_one():
    rnd = random.Random(3)
    for _ in range(3000):
        raw = "".join(rnd.choice(['"', '""', ",", "a", "\n", '"b"', ',"']) for _ in range(rnd.randint(0, 12)))
        want = fields_of(raw)
        got, reason, edits = read_csv(raw)
        if want is None:
            assert (got, reason) == (None, "quoting") and edits
        elif len(want) != 4:
            assert (got, reason) == (None, "columns") and edits
        else:
            assert list(got.values()) == want and not edits


def test_parse_raw(spark):
    ok = "product/productId: B1\nreview/helpfulness: 1/2\nreview/score: 4.5\nreview/text: a\nReview/text: b\n"
    data = [
        (1, "csv", 'B1,1/2, 4.5 ,"a ""b"", c\nd"'),
        (2, "csv", 'B1,1/2,4,"open'),
        (3, "csv", 'B1,1/2,4,"a"b'),
        (4, "csv", "B1,1/2,4"),
        (5, "csv", "B1,3/2,6,bad\x07"),
        (6, "csv", "B1,1 of 2,1e0,x�"),
        (7, "dump", ok),
        (8, "dump", ok + "review/score: 3"),
        (9, "dump", "Review/text: x"),
        (10, None, "x"),
        (11, "csv", None),
        (12, "csv", ""),
        (13, "csv", "B1,0/0,5,"),
        (14, "csv", "B1,99999999999999999999/99999999999999999999,5.01,t"),
        (15, "csv", "B1,1/2,2.5,tab\tline\n"),
        (16, "xml", "B1,1/2,2.5,t"),
    ]
    df = spark.createDataFrame([(*x, "clash") for x in data], "raw_id bigint, fmt string, raw string, reasons string")
    p = parse_raw(df)
    bad = {}
    for r in rejected(p).collect():
        bad.setdefault(r.id, []).append(r.reason)
    assert bad == {
        2: ["quoting"], 3: ["quoting"], 4: ["columns"], 5: ["helpfulness", "score", "text"], 6: ["helpfulness", "score", "text"],
        8: ["columns"], 9: ["columns"], 10: ["columns"], 11: ["columns"], 12: ["columns"], 14: ["helpfulness", "score"], 16: ["columns"],
    }
    good = {r.id: r for r in loaded(p).collect()}
    assert sorted(good) == [1, 7, 13, 15]
    assert (good[1].text, good[1].score, good[1].helpfulness_num) == ('a "b", c\nd', 4.5, 1)
    assert good[7].text == "a\nReview/text: b\n"
    assert good[13].text == ""
    edits = {r.id: r.edits for r in rejected(p).collect()}
    assert edits[2] == ["insert quote @14"] and edits[4] and edits[8] == ["delete score"]
    assert parse_raw(df.limit(0)).count() == 0
    assert len(CSV_FIELDS) == 4


def exact(values, q):
    v = sorted(values)
    return v[max(math.ceil(q * len(v)), 1) - 1] if v else None


def test_hot_keys(spark):
    rnd = random.Random(4)
    for n, share in ((0, 40), (1, 40), (39, 40), (40, 40), (41, 40), (2000, 40), (2000, 3), (500, 1)):
        rows = [(rnd.choice(["a", "b", "c", None, *(f"k{i}" for i in range(60))]), rnd.choice([1, 1, 2, None, 9])) for _ in range(n)]
        rows += [("edge", n // share), ("more", n // share + 1)] if n else []
        by = Counter()
        for k, w in rows:
            by[k] += 1 if w is None else w
        total = sum(by.values())
        df = spark.createDataFrame(rows, "key string, weight int").withColumn("v", F.lit(0))
        got = {r.key: r.weight for r in hot_keys(df, share, bins=5).collect()}
        assert got == {k: w for k, w in by.items() if k is not None and w * share > total}


@pytest.mark.parametrize("hot_share", [1, 3, 1024, 0])
def test_key_profile(spark, hot_share):
    rnd = random.Random(hot_share)
    rows = []
    for k, n in (("hot", 3000), ("warm", 300), ("cold", 5), ("one", 1), (None, 40), ("flat", 50)):
        rows += [(k, 7.0 if k == "flat" else rnd.choice([rnd.gauss(0, 1e6), float(rnd.randint(0, 5)), rnd.random() * 1e-9]), 1) for _ in range(n)]
    rows += [("hot", None, 1), ("nulls", None, 2), ("nulls", float("nan"), 1), ("cold", float("inf"), 1), ("warm", 2.0, 25), ("warm", 3.0, None), ("big", -1.7e308, 1), ("big", 1.7e308, 2)]
    qs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r.key: r for r in key_profile(spark.createDataFrame(rows, "key string, value double, weight int"), qs, bins=4, **({"hot_share": hot_share} if hot_share else {"hot_share": 1, "most": 20})).collect()}
    for k in {r[0] for r in rows}:
        mine = [(v, w or 1) for x, v, w in rows if x == k]
        values = [v for v, w in mine if v is not None and math.isfinite(v) for _ in range(w)]
        r = got[k]
        assert r.n == sum(w for _, w in mine)
        assert [r[f"q{i}"] for i in range(len(qs))] == [exact(values, q) for q in qs], k
        if values and k != "big":
            assert r.mean == pytest.approx(sum(values) / len(values))
    assert got["nulls"].mean is None
    empty = spark.createDataFrame([], "key string, value double, weight int")
    assert key_profile(empty).count() == 0
    with pytest.raises(ValueError):
        key_profile(empty, (2.0,))


def test_keyed_lists(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 1), ("a", 12), ("b", 2), (None, 4), ("c", None)], "k string, i int").withColumn("items", F.lit(0))
    got = {(r.key, r.segment): r["items"] for r in keyed_lists(df, "k", "i", span=10).collect()}
    assert got == {("a", 0): [1, 3], ("a", 1): [12], ("b", 0): [2]}


def test_tf_histogram(spark):
    df = spark.createDataFrame([("a a b",), ("A",), (None,), ("",), ("b b",)], "text string")
    assert sorted(map(tuple, tf_histogram(df).collect())) == [("a", 1, 1), ("a", 2, 1), ("b", 1, 1), ("b", 2, 1)]
    assert tf_histogram(df.limit(0)).count() == 0


def test_streaming(spark, tmp_path):
    from reviewloom.streaming.reviews import first_deliveries, parse_stream, token_counts

    src = str(tmp_path / "in")
    data = [(1, "tea Tea", "2024-01-01 00:10:00"), (1, "tea Tea", "2024-01-01 00:20:00"), (2, "cup", "2024-01-01 00:30:00"), (3, "end", "2024-01-09 00:00:00")]
    df = spark.createDataFrame(data, "review_id bigint, text string, t string").withColumn("loaded_at", F.to_timestamp("t")).drop("t")
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)

    def run(frame, name, mode):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    assert run(first_deliveries(stream), "first", "append").count() == 3
    got = {(r.token, r.cf) for r in run(token_counts(stream), "counts", "complete").collect()}
    assert got == {("tea", 4), ("cup", 1), ("end", 1)}
    rec = stream.select(F.concat(F.lit("product/productId: P\nreview/score: 1\nreview/text: "), "text").alias("record"))
    assert {r.text for r in run(parse_stream(rec), "parsed", "append").collect()} == {"tea Tea", "cup", "end"}
