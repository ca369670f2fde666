"""Queries of the review index, each with its SQL counterpart over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions import codecs
from reviewloom.functions.tokens import token_count
from reviewloom.operators import build, lookup, rank
from reviewloom.operators.reviews import REPEATED, current_reviews
from reviewloom.session import shared_path, stash
from reviewloom.sources.dump import parse_records, read_dump, split_valid, write_dump
from reviewloom.sources.index import drop_index, open_index, write_index
from reviewloom.sources.tables import documents_as_reviews, table

QUERY = "the great battery under my kettle"
TOKEN_PROBES = ("the", "THE", "zzzznotatoken", "tea/coffee", "kettle")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_R = "r AS (SELECT DISTINCT ON (review_id) * FROM reviews ORDER BY review_id, loaded_at)"
_OCC = _R + ", occ AS (SELECT review_id, lower(t) AS token FROM (SELECT review_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9]+')) AS t FROM r))"
_POST = _OCC + ", post AS (SELECT token, review_id, CAST(count(*) AS BIGINT) AS tf FROM occ GROUP BY ALL)"
_STATS = _POST + ", stats AS (SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY token)"
_DICT = _STATS + ", dict AS (SELECT row_number() OVER (ORDER BY token) - 1 AS token_num, token, df, cf, CAST(length(token) AS INT) AS token_length FROM stats)"
_SEG = f"review_id // {build.SEGMENT}"
_GAPS = _POST + ", gaps AS (SELECT token, review_id, review_id - lag(review_id, 1, 0) OVER (PARTITION BY token ORDER BY review_id) AS gap, tf FROM post)"


def _delta_sql(n: str) -> str:
    b = f"bin({n} + 1)"
    c = f"bin(length({b}))"
    return f"(repeat('1', length({c}) - 1) || '0' || substr({c}, 2) || substr({b}, 2))"


_BYTES = _POST + (
    f", sg AS (SELECT token, {_SEG} AS segment, review_id, tf, review_id - lag(review_id, 1, 0) OVER (PARTITION BY token, {_SEG} ORDER BY review_id) AS gap FROM post)"
    f", bits AS (SELECT token, segment, string_agg({_delta_sql('gap')} || {_delta_sql('tf')}, '' ORDER BY review_id) AS b FROM sg GROUP BY ALL)"
    ", coded AS (SELECT token, segment, hex(from_binary(rpad(b, CAST(8 * ceil(length(b) / 8.0) AS INT), '0'))) AS hex, CAST(ceil(length(b) / 8.0) AS BIGINT) AS n_bytes FROM bits)"
)
_HEXOF = "(CASE WHEN length(printf('%X', {0})) % 2 = 1 THEN '0' ELSE '' END || printf('%X', {0}))"
_NUMS = _R + ", nums AS (SELECT product_id, row_number() OVER (ORDER BY product_id) - 1 AS product_num FROM (SELECT DISTINCT product_id FROM r WHERE product_id IS NOT NULL))"
_PACK = _NUMS + (
    ", pk AS (SELECT review_id, coalesce(nums.product_num, 0) AS v0, coalesce(helpfulness_num, 0) AS v1, coalesce(helpfulness_denom, 0) AS v2,"
    " coalesce(len(regexp_extract_all(text, '[a-zA-Z0-9]+')), 0) AS v3 FROM r LEFT JOIN nums ON r.product_id = nums.product_id)"
    ", hx AS (SELECT review_id, " + ", ".join(f"{_HEXOF.format(f'v{i}')} AS h{i}" for i in range(4)) + " FROM pk)"
)
_WEIGHTS = (
    ", m AS (SELECT product_id, max(helpfulness_denom) AS md, max(length) AS ml FROM r WHERE product_id IS NOT NULL GROUP BY 1)"
    ", w AS (SELECT review_id, r.product_id, score,"
    " CASE WHEN helpfulness_denom > 0 AND md > 0 THEN coalesce(CAST(helpfulness_num AS DOUBLE) / helpfulness_denom * (CAST(helpfulness_denom AS DOUBLE) / md), 0.0) ELSE 0.0 END AS hn,"
    " CASE WHEN ml > 0 THEN coalesce(CAST(length AS DOUBLE) / ml, 0.0) ELSE 0.0 END AS ln FROM r JOIN m ON r.product_id = m.product_id)"
    ", ww AS (SELECT *, 0.5::DOUBLE * ln + 0.5::DOUBLE * hn AS weight FROM w)"
)
_QUALITY = _R + _WEIGHTS + ", quality AS (SELECT product_id, avg(weight * coalesce(score, 0)) * ln(count(*) + 1) AS quality FROM ww GROUP BY 1)"
_SEARCH = _STATS + (
    f", q AS (SELECT lower(t) AS token, count(*) AS q_tf FROM (SELECT unnest(regexp_extract_all('{QUERY}', '[a-zA-Z0-9]+')) AS t) GROUP BY 1)"
    ", kn AS (SELECT token, (1 + log10(q_tf)) * log10(CAST((SELECT count(*) FROM r) AS DOUBLE) / df) AS w FROM q JOIN stats USING (token))"
    ", kw AS (SELECT token, w / sqrt(sum(w * w) OVER ()) AS w FROM kn)"
    ", sc AS (SELECT review_id, round(sum(w * (1 + log10(tf))), 12) AS score FROM post JOIN kw USING (token) GROUP BY 1)"
    ", hits AS (SELECT review_id, score, row_number() OVER (ORDER BY score DESC, review_id) AS rank FROM sc)"
)
_RELEVANCE = _SEARCH + _WEIGHTS + ", rel AS (SELECT product_id, sum(weight * 5.0::DOUBLE / rank) AS relevance FROM hits JOIN ww USING (review_id) GROUP BY 1)"
_RANK = (
    _RELEVANCE
    + ", quality AS (SELECT product_id, avg(weight * coalesce(score, 0)) * ln(count(*) + 1) AS quality FROM ww GROUP BY 1)"
    + ", ranked AS (SELECT product_id, quality, relevance, 0.7::DOUBLE * relevance + 0.3::DOUBLE * quality AS rank_value FROM rel JOIN quality USING (product_id))"
)
_TPROBES = ", ".join(f"('{t}')" for t in TOKEN_PROBES)
_RPROBES = "probes AS (SELECT unnest([-1, 0, 1, 2, (SELECT max(review_id) FROM r), (SELECT max(review_id) + 1 FROM r)]) AS probe)"
_PPROBES = "probes AS (SELECT unnest([(SELECT min(product_id) FROM r), (SELECT max(product_id) FROM r), 'B999999999', (SELECT lower(min(product_id)) FROM r)]) AS probe)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = "WITH " + sql
        return f

    return add


def _reviews(s: SparkSession, d: str, *columns: str) -> DataFrame:
    # rows without texts are exchanged; texts stay where they are read
    return current_reviews(table(s, d, "reviews"), *columns, repeated=REPEATED if "text" in columns else 0)


def _post(s: SparkSession, d: str) -> DataFrame:
    return build.postings(_reviews(s, d, "text"))


def _stats(s: SparkSession, d: str) -> DataFrame:
    return build.token_stats_of(_reviews(s, d, "text"))


@query(_OCC + " SELECT review_id, token FROM occ")
def tokenize_explode(s, d):
    return build.occurrences(_reviews(s, d, "text"))


@query(_POST + " SELECT token, review_id, tf FROM post")
def postings(s, d):
    return _post(s, d)


@query(_STATS + " SELECT token, df FROM stats")
def token_df(s, d):
    return _stats(s, d).select("token", "df")


@query(_STATS + " SELECT token, cf FROM stats")
def token_cf(s, d):
    return _stats(s, d).select("token", "cf")


@query(
    _STATS + " SELECT (SELECT count(*) FROM r) AS n_reviews, (SELECT CAST(sum(cf) AS BIGINT) FROM stats) AS n_tokens,"
    " (SELECT count(*) FROM stats) AS n_distinct_tokens, (SELECT count(DISTINCT product_id) FROM r) AS n_products"
)
def corpus_stats(s, d):
    r = _reviews(s, d, "text", "product_id")
    return build.corpus_stats(r, build.token_stats_of(r))


@query(_R + " SELECT review_id, CAST(coalesce(len(regexp_extract_all(text, '[a-zA-Z0-9]+')), 0) AS BIGINT) AS length FROM r")
def review_length(s, d):
    return build.review_lengths(_reviews(s, d, "text"))


@query(
    _R + " SELECT review_id, product_id, CAST(trunc(CAST(score || '.5' AS FLOAT)) AS INT) AS score, CAST(split_part(helpfulness_num || '/' || helpfulness_denom, '/', 1) AS INT) AS helpfulness_num,"
    " CAST(split_part(helpfulness_num || '/' || helpfulness_denom, '/', 2) AS INT) AS helpfulness_denom, CAST(coalesce(len(regexp_extract_all(text, '[a-zA-Z0-9]+')), 0) AS BIGINT) AS length FROM r"
)
def review_table(s, d):
    """The typed columns are first turned back into the dump's text fields, so that the parse itself runs."""
    r = _reviews(s, d, "product_id", "score", "helpfulness_num", "helpfulness_denom", "text")
    raw = r.select(
        "review_id",
        "product_id",
        F.concat("score", F.lit(".5")).alias("score"),
        F.concat("helpfulness_num", F.lit("/"), "helpfulness_denom").alias("helpfulness"),
        "text",
    )
    return build.review_table(raw)


@query(_R + " SELECT product_id, min(review_id) AS first_review_id, count(*) - 1 AS span_length FROM r WHERE product_id IS NOT NULL GROUP BY 1")
def product_spans(s, d):
    return build.product_spans(_reviews(s, d, "product_id")).select("product_id", "first_review_id", "span_length")


@query(_NUMS + " SELECT product_id, product_num FROM nums")
def product_numbers(s, d):
    return build.products(_reviews(s, d, "product_id")).select("product_id", "product_num")


@query(_DICT + " SELECT token_num, token, df, cf, token_length FROM dict")
def token_dictionary(s, d):
    return build.token_dictionary(_stats(s, d))


@query(_BYTES + " SELECT token, segment, rpad(b, CAST(8 * n_bytes AS INT), '0') AS bits FROM bits JOIN coded USING (token, segment)")
def postings_bits(s, d):
    """The packed bytes as strings of bits again."""
    c = codecs.coded_segments(build.postings_gaps(_post(s, d)))
    return c.select("token", "segment", codecs.unpack_bits("data").alias("bits"))


@query(_POST + f" SELECT token, {_SEG} AS segment, string_agg(review_id || ',' || tf, ',' ORDER BY review_id) AS postings FROM post GROUP BY ALL")
def postings_flat(s, d):
    return build.postings_flat(_post(s, d))


@query(_GAPS + " SELECT token, review_id, gap, tf FROM gaps")
def postings_gaps(s, d):
    return build.postings_gaps(_post(s, d))


@query(_POST + " SELECT token, review_id, tf FROM post")
def postings_gaps_roundtrip(s, d):
    return build.gaps_to_ids(build.gap_lists(build.postings_gaps(_post(s, d))))


@query(
    _POST + f" SELECT token, {_SEG} AS segment, string_agg(review_id, ',' ORDER BY review_id) AS ids, string_agg(tf, ',' ORDER BY review_id) AS frequencies FROM post GROUP BY ALL"
)
def postings_slices(s, d):
    """The two halves of the flat lists."""
    flat = build.postings_flat(_post(s, d)).withColumn("l", F.split("postings", ","))
    return flat.select("token", "segment", *[F.array_join(build.flat_part(F.col("l"), p), ",").alias(p) for p in ("ids", "frequencies")])


@query(_POST + " SELECT token, review_id, tf FROM post")
def postings_decoded(s, d):
    """Whole coded segments read back."""
    return codecs.decoded_postings(codecs.coded_segments(build.postings_gaps(_post(s, d))))


@query(_R + " SELECT review_id AS n, repeat('1', length(bin(review_id + 1)) - 1) || '0' || substr(bin(review_id + 1), 2) AS code FROM r")
def gamma_codes(s, d):
    return _reviews(s, d).select(F.col("review_id").alias("n"), codecs.gamma("review_id").alias("code"))


@query(_R + f" SELECT review_id AS n, {_delta_sql('review_id')} AS code FROM r")
def delta_codes(s, d):
    return _reviews(s, d).select(F.col("review_id").alias("n"), codecs.delta("review_id").alias("code"))


def _coded_pair(s, d, encode, decode):
    n = _reviews(s, d).select(F.col("review_id").alias("n"))
    bits = n.select("n", F.concat(encode("n"), encode(F.col("n") % 7)).alias("b"))
    packed = bits.select("n", codecs.pack_bits("b").alias("b"))
    dec = packed.select("n", decode("b", F.lit(2)).alias("v"))
    return dec.select("n", F.array_join(F.col("v").cast("array<string>"), ",").alias("decoded"))


@query(_R + " SELECT review_id AS n, review_id || ',' || (review_id % 7) AS decoded FROM r")
def gamma_roundtrip(s, d):
    return _coded_pair(s, d, codecs.gamma, codecs.gamma_decode)


@query(_R + " SELECT review_id AS n, review_id || ',' || (review_id % 7) AS decoded FROM r")
def delta_roundtrip(s, d):
    return _coded_pair(s, d, codecs.delta, codecs.delta_decode)


@query(_BYTES + " SELECT token, segment, hex, n_bytes FROM coded")
def postings_bytes(s, d):
    return codecs.delta_coded_postings(build.postings_gaps(_post(s, d)))


@query(
    _BYTES + ", t AS (SELECT token, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM coded GROUP BY 1)"
    " SELECT token, CAST(coalesce(sum(n_bytes) OVER (ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset, n_bytes FROM t"
)
def postings_offsets(s, d):
    return build.byte_offsets(codecs.delta_coded_postings(build.postings_gaps(_post(s, d))))


def _packed_reviews(s, d):
    r = _reviews(s, d, "product_id", "helpfulness_num", "helpfulness_denom", "text")
    nums = build.products(r).select("product_id", "product_num")
    zero = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0))
    full = r.join(nums, "product_id", "left").withColumn("length", token_count("text"))
    return full.select("review_id", codecs.group_varint(zero("product_num"), zero("helpfulness_num"), zero("helpfulness_denom"), "length").alias("b"))


@query(
    _PACK + " SELECT review_id, printf('%02X', CAST((length(h0) // 2 - 1) * 64 + (length(h1) // 2 - 1) * 16 + (length(h2) // 2 - 1) * 4 + length(h3) // 2 - 1 AS INT)) || h0 || h1 || h2 || h3 AS hex FROM hx"
)
def group_varint(s, d):
    return _packed_reviews(s, d).select("review_id", F.hex("b").alias("hex"))


@query(_PACK + " SELECT review_id, v0 AS product_num, CAST(v1 AS BIGINT) AS helpfulness_num, CAST(v2 AS BIGINT) AS helpfulness_denom, v3 AS length FROM pk")
def group_varint_roundtrip(s, d):
    v = _packed_reviews(s, d).select("review_id", codecs.group_varint_decode("b").alias("v"))
    return v.select("review_id", F.col("v.v0").alias("product_num"), F.col("v.v1").alias("helpfulness_num"), F.col("v.v2").alias("helpfulness_denom"), F.col("v.v3").alias("length"))


@query(
    _PACK.replace("v3 FROM r", "v3, coalesce(score, 0) AS v4 FROM r").replace("FROM pk)", ", v4 FROM pk)")
    + " SELECT review_id, printf('%02X', CAST((length(h0) // 2 - 1) * 64 + (length(h1) // 2 - 1) * 16 + (length(h2) // 2 - 1) * 4 + length(h3) // 2 - 1 AS INT)) || h0 || h1 || h2 || h3 || printf('%02X', v4) AS hex FROM hx"
)
def review_rows(s, d):
    """The stored form of a review: four numbers and the score byte."""
    return _stored_reviews(s, d).select("review_id", F.hex("b").alias("hex"))


def _stored_reviews(s, d):
    r = _reviews(s, d, "product_id", "helpfulness_num", "helpfulness_denom", "score", "text")
    full = r.join(build.products(r).select("product_id", "product_num"), "product_id", "left").withColumn("length", token_count("text"))
    return full.select("review_id", codecs.review_row("product_num", "helpfulness_num", "helpfulness_denom", "length", "score").alias("b"))


@query(
    _PACK.replace("v3 FROM r", "v3, coalesce(score, 0) AS v4 FROM r")
    + " SELECT review_id, v0 AS product_num, CAST(v1 AS BIGINT) AS helpfulness_num, CAST(v2 AS BIGINT) AS helpfulness_denom, v3 AS length, v4 AS score FROM pk"
)
def review_rows_roundtrip(s, d):
    v = _stored_reviews(s, d).select("review_id", codecs.review_row_decode("b").alias("r"))
    names = ("product_num", "helpfulness_num", "helpfulness_denom", "length")
    return v.select("review_id", *[F.col(f"r.v.v{i}").alias(n) for i, n in enumerate(names)], F.col("r.score").alias("score"))


_FRONT = (
    ", fc AS (SELECT token_num, token, token_num % 8 AS o, CASE WHEN token_num % 8 = 0 THEN 0 ELSE"
    " coalesce(list_max(list_filter(range(1, length(token) + 1), lambda i: i <= length(prev) AND left(token, CAST(i AS INT)) = left(prev, CAST(i AS INT)))), 0) END AS p"
    " FROM (SELECT *, lag(token) OVER (ORDER BY token_num) AS prev FROM dict))"
    ", fs AS (SELECT *, substr(token, CAST(p + 1 AS INT)) AS suffix FROM fc)"
    " SELECT token_num AS {0}, CAST(o AS INT) AS block_offset, CASE WHEN o > 0 THEN CAST(p AS INT) END AS prefix_len, suffix,"
    " CASE WHEN o = 0 THEN CAST(coalesce(sum(length(suffix)) OVER (ORDER BY token_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END AS pointer FROM fs"
)


@query(_DICT + _FRONT.format("token_num"))
def front_coding(s, d):
    return codecs.front_coding(build.token_dictionary(_stats(s, d)))


@query(_DICT + " SELECT token_num, token FROM dict")
def front_coding_roundtrip(s, d):
    return codecs.front_decoding(codecs.front_coding(build.token_dictionary(_stats(s, d))))


_PROD = _NUMS + ", dict AS (SELECT product_num AS token_num, product_id AS token FROM nums)"


@query(_PROD + _FRONT.format("product_num"))
def product_front_coding(s, d):
    return codecs.front_coding(build.products(_reviews(s, d, "product_id")), "product_num", "product_id")


@query(_NUMS + " SELECT product_num, product_id FROM nums")
def product_front_coding_roundtrip(s, d):
    coded = codecs.front_coding(build.products(_reviews(s, d, "product_id")), "product_num", "product_id")
    return codecs.front_decoding(coded, "product_num", "product_id")


_indexes: dict[tuple[str, str], str] = {}


def _index(s, d) -> lookup.ReviewLookup:
    """The persisted index of a folder's reviews, built once per application: lookups read it with pruning."""
    key = (s.sparkContext.applicationId, d)
    if key not in _indexes:
        path = shared_path(s, "index")
        write_index(_reviews(s, d, "product_id", "score", "helpfulness_num", "helpfulness_denom", "text"), path)
        _indexes[key] = path
    return open_index(s, _indexes[key])


def _token_probes(s):
    # an expression of known size, so that Catalyst can see it is small
    return s.range(1).select(F.explode(F.array(*map(F.lit, TOKEN_PROBES))).alias("probe"))


def _review_probes(s, r):
    n = r.agg(F.max("review_id").alias("n"))
    return n.select(F.explode(F.array(*[F.lit(x).cast("bigint") for x in (-1, 0, 1, 2)], F.col("n"), F.col("n") + 1)).alias("probe"))


def _product_probes(r):
    m = r.agg(F.min("product_id").alias("a"), F.max("product_id").alias("b"))
    return m.select(F.explode(F.array("a", "b", F.lit("B999999999"), F.lower("a"))).alias("probe"))


@query(_DICT + f", probes AS (SELECT * FROM (VALUES {_TPROBES}) v(probe)) SELECT probe, coalesce(token_num, -1) AS token_num FROM probes LEFT JOIN dict ON lower(probe) = token")
def token_lookup(s, d):
    return lookup.token_numbers(_token_probes(s), _index(s, d).tokens)


@query(_STATS + f", probes AS (SELECT * FROM (VALUES {_TPROBES}) v(probe)) SELECT probe, coalesce(df, 0) AS df, coalesce(cf, 0) AS cf FROM probes LEFT JOIN stats ON lower(probe) = token")
def token_freq_lookup(s, d):
    return lookup.token_frequencies(_token_probes(s), _index(s, d).tokens)


@query(_POST + f", probes AS (SELECT * FROM (VALUES {_TPROBES}) v(probe)) SELECT probe, review_id, tf FROM probes JOIN post ON lower(probe) = token")
def postings_lookup(s, d):
    return lookup.token_postings(_token_probes(s), _index(s, d).postings)


@query(
    _R + f", {_RPROBES} SELECT probe, coalesce(score, -1) AS score, coalesce(helpfulness_num, -1) AS helpfulness_num, coalesce(helpfulness_denom, -1) AS helpfulness_denom,"
    " coalesce(length, -1) AS length FROM probes LEFT JOIN r ON probe = review_id"
)
def review_attr_lookup(s, d):
    r = _reviews(s, d, *lookup.ATTRIBUTES)
    return lookup.review_attributes(_review_probes(s, r), r)


@query(_R + f", {_RPROBES} SELECT probe, product_id FROM probes LEFT JOIN r ON probe = review_id")
def review_product_lookup(s, d):
    r = _reviews(s, d, "product_id")
    return lookup.review_products(_review_probes(s, r), r)


@query(_R + f", {_PPROBES} SELECT probe, review_id FROM probes JOIN r ON probe = product_id")
def product_reviews(s, d):
    r = _reviews(s, d, "product_id")
    return lookup.product_reviews(_product_probes(r), r)


@query(
    _R + f", {_PPROBES}, sp AS (SELECT product_id, min(review_id) AS a, min(review_id) + count(*) AS b FROM r WHERE product_id IS NOT NULL GROUP BY 1)"
    " SELECT probe, unnest(range(a, b)) AS review_id FROM probes JOIN sp ON probe = product_id"
)
def product_reviews_range(s, d):
    r = _reviews(s, d, "product_id")
    return lookup.product_reviews_range(_product_probes(r), build.product_spans(r))


@query(
    _STATS + " SELECT (SELECT count(*) FROM r) AS n_reviews, (SELECT CAST(coalesce(sum(cf), 0) AS BIGINT) FROM stats) AS n_tokens"
)
def index_totals(s, d):
    x = _index(s, d)
    return s.createDataFrame([(x.number_of_reviews(), x.token_size_of_reviews())], "n_reviews bigint, n_tokens bigint")


@query(
    _NUMS + " SELECT review_id, r.product_id, nums.product_num, score, helpfulness_num, helpfulness_denom, CAST(coalesce(len(regexp_extract_all(text, '[a-zA-Z0-9]+')), 0) AS BIGINT) AS length, text"
    " FROM r LEFT JOIN nums ON r.product_id = nums.product_id"
)
def index_reviews(s, d):
    return _index(s, d).reviews


@query(
    _NUMS + " SELECT nums.product_num, product_id, min(review_id) AS first_review_id, count(*) - 1 AS span_length, count(*) AS n_reviews FROM r JOIN nums USING (product_id) GROUP BY ALL"
)
def index_products(s, d):
    return _index(s, d).products


@query(_DICT + " SELECT token_num, token, df, cf, token_length FROM dict")
def index_tokens(s, d):
    return _index(s, d).tokens


@query(_POST + " SELECT token, review_id, tf FROM post")
def index_postings(s, d):
    return _index(s, d).postings


@query(_POST + " SELECT review_id, tf FROM post WHERE token = 'kettle'")
def index_reviews_with_token(s, d):
    """The getter for one token, over files sorted by token: their minima and maxima leave few row groups to read."""
    return _index(s, d).reviews_with_token("Kettle")


@query(
    _R + f", {_RPROBES} SELECT probe, coalesce(score, -1) AS score, coalesce(helpfulness_num, -1) AS helpfulness_num, coalesce(helpfulness_denom, -1) AS helpfulness_denom,"
    " coalesce(CASE WHEN review_id IS NOT NULL THEN coalesce(len(regexp_extract_all(text, '[a-zA-Z0-9]+')), 0) END, -1) AS length, product_id FROM probes LEFT JOIN r ON probe = review_id"
)
def index_review_lookup(s, d):
    x = _index(s, d)
    probes = _review_probes(s, x.reviews)
    return lookup.review_attributes(probes, x.reviews).join(lookup.review_products(probes, x.reviews), "probe")


@query(_R + f", {_PPROBES} SELECT probe, review_id FROM probes JOIN r ON probe = product_id")
def index_product_reviews(s, d):
    x = _index(s, d)
    return lookup.product_reviews(_product_probes(x.reviews), x.reviews)


@query("o AS (SELECT 4 AS tables, true AS dropped, false AS dropped_again) SELECT * FROM o")
def index_drop(s, d):
    """Builds an index of the products' reviews, drops it, and drops it again: what was there and what was done."""
    path = shared_path(s, "dropped-index")
    write_index(_reviews(s, d, "product_id", "score", "helpfulness_num", "helpfulness_denom", "text"), path)
    x = open_index(s, path)
    n = len({t.inputFiles()[0].rpartition("/")[0] for t in (x.reviews, x.products, x.tokens, x.postings) if t.inputFiles()})
    return s.createDataFrame([(n, drop_index(s, path), drop_index(s, path))], "tables int, dropped boolean, dropped_again boolean")


def _rated(s, d):
    return _reviews(s, d, "product_id", *lookup.ATTRIBUTES)


def _weights(s, d):
    return rank.review_weights(_rated(s, d))


@query(_R + _WEIGHTS + " SELECT review_id, round(hn, 6) AS value FROM ww")
def helpfulness_norm(s, d):
    return _weights(s, d).select("review_id", F.round("helpfulness_norm", 6).alias("value"))


@query(_R + _WEIGHTS + " SELECT review_id, round(ln, 6) AS value FROM ww")
def length_norm(s, d):
    return _weights(s, d).select("review_id", F.round("length_norm", 6).alias("value"))


@query(_R + _WEIGHTS + " SELECT review_id, round(weight, 6) AS value FROM ww")
def review_weight(s, d):
    return _weights(s, d).select("review_id", F.round("weight", 6).alias("value"))


@query(_QUALITY + " SELECT product_id, round(quality, 6) AS quality FROM quality")
def product_quality(s, d):
    return rank.product_quality(_rated(s, d)).select("product_id", F.round("quality", 6).alias("quality"))


def _hits(s, d):
    r = _reviews(s, d, "text")
    # read by the frequencies and by the scores
    post = stash(rank.matching_postings(QUERY, r), "matching-postings")
    n = table(s, d, "reviews").agg(F.count_distinct("review_id")).head()[0]
    return rank.vector_space_search(QUERY, post, build.token_stats(post), n)


@query(_SEARCH + " SELECT review_id, round(score, 6) AS score, rank FROM hits")
def vector_space_search(s, d):
    return _hits(s, d).select("review_id", F.round("score", 6).alias("score"), "rank")


@query(_RELEVANCE + " SELECT product_id, round(relevance, 6) AS relevance FROM rel")
def product_relevance(s, d):
    return rank.product_relevance(_hits(s, d), _weights(s, d)).select("product_id", F.round("relevance", 6).alias("relevance"))


def _ranked(s, d):
    r = _rated(s, d)
    return rank.product_rank(rank.product_relevance(_hits(s, d), rank.review_weights(r)), rank.product_quality(r))


@query(_RANK + " SELECT product_id, round(quality, 6) AS quality, round(relevance, 6) AS relevance, round(rank_value, 6) AS rank_value FROM ranked")
def product_rank(s, d):
    return _ranked(s, d).select("product_id", *[F.round(c, 6).alias(c) for c in ("quality", "relevance", "rank_value")])


@query(_RANK + " SELECT product_id, round(rank_value, 6) AS rank_value FROM ranked ORDER BY round(ranked.rank_value, 12) DESC, product_id LIMIT 10")
def product_search(s, d):
    return rank.product_search(_ranked(s, d)).select("product_id", F.round("rank_value", 6).alias("rank_value"))


@query(
    "a AS (SELECT doc_id + 1 AS review_id, 'B' || lpad(CAST(doc_id // 10 AS VARCHAR), 9, '0') AS product_id, CAST(1 + (doc_id * 7) % 5 AS INT) AS score, CAST((doc_id * 3) % 11 AS INT) AS helpfulness_denom,"
    " CAST((doc_id * 5) % ((doc_id * 3) % 11 + 1) AS INT) AS helpfulness_num, CAST(coalesce(len(regexp_extract_all(text, '[a-zA-Z0-9]+')), 0) AS BIGINT) AS length FROM documents) SELECT * FROM a"
)
def document_reviews(s, d):
    r = documents_as_reviews(table(s, d, "documents"))
    return r.withColumn("length", token_count("text")).drop("text")


_TEXT = r"regexp_replace(regexp_replace(text, '\n((?:product|review)/\w+: )', chr(10) || ' \1', 'g'), '\n+$', '')"
_SOUND = "score IS NOT NULL AND text IS NOT NULL AND helpfulness_num IS NOT NULL AND helpfulness_denom IS NOT NULL"


def _dump(s, d):
    """All reviews as a dump, written and scanned."""
    path = shared_path(s, "dump")
    write_dump(_reviews(s, d, "product_id", "score", "helpfulness_num", "helpfulness_denom", "text"), path)
    return read_dump(s, path)


@query(
    _R + f" SELECT row_number() OVER (ORDER BY review_id) AS review_id, trim(product_id) AS product_id, helpfulness_num || '/' || helpfulness_denom AS helpfulness, CAST(score AS VARCHAR) AS score, {_TEXT} AS text"
    f" FROM r WHERE coalesce(trim(product_id), '') <> '' AND {_SOUND}"
)
def dump_scan(s, d):
    """All fields of the valid records of a dump, with dense ids in file order."""
    return _dump(s, d)[0]


@query(
    _R + " SELECT reason, count(*) AS n FROM (SELECT CASE WHEN coalesce(trim(product_id), '') = '' THEN 'missing product_id' WHEN text IS NULL THEN 'missing text'"
    " WHEN helpfulness_num IS NULL OR helpfulness_denom IS NULL THEN 'missing helpfulness' WHEN score IS NULL THEN 'missing score' END AS reason FROM r) WHERE reason IS NOT NULL GROUP BY 1"
)
def dump_quarantine(s, d):
    return _dump(s, d)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "l AS (SELECT raw_id, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) AS i FROM raw_reviews WHERE fmt = 'dump'),"
    r" o AS (SELECT *, sum(CAST(regexp_matches(line, '^(product|review)/\w+: ') AS INT)) OVER (PARTITION BY raw_id ORDER BY i) AS g FROM l),"
    r" f AS (SELECT raw_id, g, regexp_extract(first(line ORDER BY i), '^((?:product|review)/\w+):', 1) AS name, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^(product|review)/\w+: ', '') AS v FROM o GROUP BY ALL),"
    " k AS (SELECT raw_id, name, first(v ORDER BY g) AS v FROM f GROUP BY ALL),"
    " p AS (SELECT raw_id, max(v) FILTER (name = 'product/productId') AS product_id, max(v) FILTER (name = 'review/helpfulness') AS helpfulness, max(v) FILTER (name = 'review/score') AS score, max(v) FILTER (name = 'review/text') AS text FROM k GROUP BY 1),"
    " q AS (SELECT raw_id, trim(split_part(product_id, chr(10), 1)) AS product_id, trim(split_part(helpfulness, chr(10), 1)) AS helpfulness, trim(split_part(score, chr(10), 1)) AS score, text FROM p)"
    " SELECT *, CASE WHEN coalesce(product_id, '') = '' THEN 'missing product_id' WHEN text IS NULL THEN 'missing text' WHEN helpfulness IS NULL THEN 'missing helpfulness' WHEN score IS NULL THEN 'missing score'"
    r" WHEN NOT regexp_full_match(helpfulness, '\s*\d+\s*/\s*\d+\s*') THEN 'bad helpfulness' WHEN try_cast(score AS FLOAT) IS NULL THEN 'bad score' END AS reason FROM q"
)
def dump_records(s, d):
    """Every dump record of the raw table with its four fields, and why it is kept out if it is."""
    raw = table(s, d, "raw_reviews").filter("fmt = 'dump'").select("raw_id", F.col("raw").alias("record"))
    good, bad = split_valid(parse_records(raw))
    cols = ["raw_id", "product_id", "helpfulness", "score", "text"]
    return good.select(*cols, F.lit(None).cast("string").alias("reason")).unionAll(bad.select(*cols, "reason"))
