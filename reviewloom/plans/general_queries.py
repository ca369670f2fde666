"""Queries of the bulk operators: rows that fail to parse, and keys that hold most rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.operators.error_parse import loaded, parse_raw, rejected
from reviewloom.operators.key_profile import hot_keys, key_profile, keyed_lists
from reviewloom.operators.reviews import current_reviews
from reviewloom.operators.term_counts import tf_histogram
from reviewloom.session import stash
from reviewloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: A key is reported as hot when it holds more than this share of the rows.
SHARE = 40

_F = '("([^"]|"")*"|[^",][^,]*|)'
_CHECKED = (
    f"""c AS (SELECT raw_id, raw, regexp_full_match(raw, '{_F}(,{_F})*') AS sound, regexp_full_match(raw, '{_F}(,{_F}){{3}}') AS four FROM raw_reviews WHERE fmt = 'csv'),
cf AS (SELECT raw_id, regexp_extract(raw, '^{_F},', 1) AS product_id,
 regexp_extract(raw, '^{_F},{_F},', 3) AS helpfulness, regexp_extract(raw, '^{_F},{_F},{_F},', 5) AS score,
 regexp_extract(raw, '^{_F},{_F},{_F},{_F}$', 7) AS text FROM c WHERE four),
cu AS (SELECT raw_id, """
    + ", ".join(f"CASE WHEN starts_with({x}, '\"') THEN replace(substr({x}, 2, length({x}) - 2), '\"\"', '\"') ELSE {x} END AS {x}" for x in ("product_id", "helpfulness", "score", "text"))
    + r""" FROM cf),
ln AS (SELECT raw_id, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) AS i FROM raw_reviews WHERE fmt = 'dump'),
op AS (SELECT *, regexp_matches(line, '^(product|review)/\w+: ') AS o FROM ln),
gr AS (SELECT *, sum(CAST(o AS INT)) OVER (PARTITION BY raw_id ORDER BY i) AS g FROM op),
fl AS (SELECT raw_id, g, regexp_extract(first(line ORDER BY i), '^((product|review)/\w+): ', 1) AS name, string_agg(CASE WHEN o THEN regexp_replace(line, '^(product|review)/\w+: ', '') ELSE line END, chr(10) ORDER BY i) AS v FROM gr WHERE g > 0 GROUP BY ALL),
dc AS (SELECT raw_id, count(*) FILTER (name = 'product/productId') AS a, count(*) FILTER (name = 'review/helpfulness') AS b, count(*) FILTER (name = 'review/score') AS c, count(*) FILTER (name = 'review/text') AS d,
 max(v) FILTER (name = 'product/productId') AS product_id, max(v) FILTER (name = 'review/helpfulness') AS helpfulness, max(v) FILTER (name = 'review/score') AS score, max(v) FILTER (name = 'review/text') AS text FROM fl GROUP BY 1),
du AS (SELECT raw_id, product_id, helpfulness, score, text FROM dc WHERE a = 1 AND b = 1 AND c = 1 AND d = 1),
u AS (SELECT raw_id, product_id, trim(helpfulness, ' ' || chr(9) || chr(10)) AS helpfulness, trim(score, ' ' || chr(9) || chr(10)) AS score, text FROM (SELECT * FROM cu UNION ALL SELECT * FROM du)),
t AS (SELECT *, try_cast(split_part(helpfulness, '/', 1) AS BIGINT) AS hn, try_cast(split_part(helpfulness, '/', 2) AS BIGINT) AS hd FROM u),
k AS (SELECT *, regexp_full_match(helpfulness, '[0-9]+/[0-9]+') AND coalesce(hn <= hd, false) AS ok_h,
 regexp_full_match(score, '[0-9]+(\.[0-9]+)?') AND coalesce(try_cast(score AS DOUBLE) BETWEEN 1 AND 5, false) AS ok_s,
 NOT regexp_matches(text, '[\x{00}-\x{08}\x{0b}-\x{1f}\x{7f}\x{fffd}]') AS ok_t FROM t)"""
)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    f"WITH {_CHECKED} SELECT raw_id, 'quoting' AS reason FROM c WHERE NOT sound UNION ALL SELECT raw_id, 'columns' FROM c WHERE sound AND NOT four"
    " UNION ALL SELECT raw_id, 'columns' FROM raw_reviews WHERE fmt = 'dump' AND raw_id NOT IN (SELECT raw_id FROM du)"
    " UNION ALL SELECT raw_id, 'helpfulness' FROM k WHERE NOT ok_h UNION ALL SELECT raw_id, 'score' FROM k WHERE NOT ok_s UNION ALL SELECT raw_id, 'text' FROM k WHERE NOT ok_t"
)
def p3_found(s, d):
    return rejected(parse_raw(table(s, d, "raw_reviews"))).select(F.col("id").alias("raw_id"), "reason")


@query(f"WITH {_CHECKED} SELECT raw_id, product_id, hn AS helpfulness_num, hd AS helpfulness_denom, CAST(score AS DOUBLE) AS score, text FROM k WHERE ok_h AND ok_s AND ok_t")
def p3_loaded(s, d):
    return loaded(parse_raw(table(s, d, "raw_reviews"))).withColumnRenamed("id", "raw_id")


def _product_rows(s, d, value: str) -> DataFrame:
    r = current_reviews(table(s, d, "reviews"), "product_id", value, repeated=0)
    # equal (product, value) rows become one with a weight before anything is kept
    h = r.groupBy("product_id", value).agg(F.count(F.lit(1)).alias("weight"))
    return stash(h.select(F.col("product_id").alias("key"), F.col(value).alias("value"), "weight"), "product-values")


def _token_rows(s, d) -> DataFrame:
    h = tf_histogram(current_reviews(table(s, d, "reviews"), "text"))
    return stash(h.select(F.col("token").alias("key"), F.col("tf").alias("value"), F.col("n").alias("weight")), "token-values")


_R = "r AS (SELECT DISTINCT ON (review_id) * FROM reviews ORDER BY review_id, loaded_at)"
_POST = _R + ", post AS (SELECT token, review_id, count(*) AS tf FROM (SELECT review_id, lower(unnest(regexp_extract_all(text, '[a-zA-Z0-9]+'))) AS token FROM r) GROUP BY ALL)"


@query(
    f"WITH {_POST} SELECT 'product' AS kind, product_id AS key_value FROM r WHERE product_id IS NOT NULL GROUP BY product_id HAVING count(*) * {SHARE} > (SELECT count(*) FROM r)"
    f" UNION ALL SELECT 'token', token FROM post GROUP BY token HAVING sum(tf) * {SHARE} > (SELECT sum(tf) FROM post)"
)
def p4_found(s, d):
    p = hot_keys(_product_rows(s, d, "length").select("key", "weight"), SHARE)
    t = hot_keys(_token_rows(s, d).select("key", (F.col("value") * F.col("weight")).alias("weight")), SHARE)
    return p.select(F.lit("product").alias("kind"), F.col("key").alias("key_value")).unionAll(t.select(F.lit("token").alias("kind"), F.col("key").alias("key_value")))


@query(
    f"WITH {_R} SELECT product_id, count(*) AS n_reviews, round(avg(length), 6) AS mean_length, CAST(quantile_disc(length, 0.5) AS DOUBLE) AS q50_length, CAST(quantile_disc(length, 0.9) AS DOUBLE) AS q90_length FROM r GROUP BY 1"
)
def p4_products(s, d):
    p = key_profile(_product_rows(s, d, "length"))
    return p.select(F.col("key").alias("product_id"), F.col("n").alias("n_reviews"), F.round("mean", 6).alias("mean_length"), F.col("q0").alias("q50_length"), F.col("q1").alias("q90_length"))


@query(
    f"WITH {_POST} SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, round(avg(tf), 6) AS mean_tf, CAST(quantile_disc(tf, 0.5) AS DOUBLE) AS q50_tf, CAST(quantile_disc(tf, 0.99) AS DOUBLE) AS q99_tf FROM post GROUP BY 1"
)
def p4_tokens(s, d):
    p = key_profile(_token_rows(s, d), (0.5, 0.99))
    return p.select(F.col("key").alias("token"), F.col("n").alias("df"), F.col("total").cast("bigint").alias("cf"), F.round("mean", 6).alias("mean_tf"), F.col("q0").alias("q50_tf"), F.col("q1").alias("q99_tf"))


@query(
    f"WITH {_R} SELECT product_id, review_id // 65536 AS segment, string_agg(review_id, ',' ORDER BY review_id) AS review_ids FROM r WHERE product_id IS NOT NULL GROUP BY ALL"
)
def p4_product_lists(s, d):
    k = keyed_lists(current_reviews(table(s, d, "reviews"), "product_id", repeated=0), "product_id", "review_id")
    return k.select(F.col("key").alias("product_id"), "segment", F.array_join(F.col("items").cast("array<string>"), ",").alias("review_ids"))


@query("SELECT token, review_id // 65536 AS segment, string_agg(review_id, ',' ORDER BY review_id) AS review_ids FROM (SELECT DISTINCT token, review_id FROM postings WHERE token IS NOT NULL AND review_id IS NOT NULL) GROUP BY ALL")
def p4_token_lists(s, d):
    k = keyed_lists(table(s, d, "postings"), "token", "review_id")
    return k.select(F.col("key").alias("token"), "segment", F.array_join(F.col("items").cast("array<string>"), ",").alias("review_ids"))


@query(
    "SELECT token, CAST(sum(df) AS BIGINT) AS df, CAST(sum(cf) AS BIGINT) AS cf, round(avg(df), 6) AS mean_df, CAST(quantile_disc(df, 0.5) AS DOUBLE) AS q50_df FROM (SELECT DISTINCT segment, token, df, cf FROM tokens) GROUP BY 1"
)
def p4_segment_tokens(s, d):
    """Per token over the dictionary's segments, repeated rows once."""
    t = table(s, d, "tokens").select("segment", "token", "df", "cf").distinct()
    p = key_profile(stash(t.select(F.col("token").alias("key"), F.col("df").alias("value"), F.lit(1).alias("weight")), "segment-df"), (0.5,))
    cf = t.groupBy("token").agg(F.sum("cf").alias("cf"))
    j = p.join(cf, F.col("key").eqNullSafe(F.col("token")))
    return j.select("token", F.col("total").cast("bigint").alias("df"), "cf", F.round("mean", 6).alias("mean_df"), F.col("q0").alias("q50_df"))
