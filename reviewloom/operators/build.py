"""Index tables from review rows: postings, token dictionary, review and product tables, corpus totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.tokens import token_count, tokens
from reviewloom.operators.numbering import dense_index, global_prefix
from reviewloom.operators.term_counts import review_terms, tf_histogram

#: Postings of a token are kept in segments of this many review ids, so no list grows without bound.
SEGMENT = 65_536


def occurrences(reviews: DataFrame) -> DataFrame:
    """One row per token occurrence. Reviews without tokens give no row."""
    return reviews.select("review_id", F.explode(tokens("text")).alias("token"))


def postings(reviews: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """(token, review_id, tf) of reviews that come once each (see current_reviews), of all tokens or of some. Nothing is exchanged."""
    return review_terms(reviews, only)


def token_stats(post: DataFrame) -> DataFrame:
    """(token, df, cf); partial sums are combined on the map side, so common tokens move one row per task."""
    return post.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def token_stats_of(reviews: DataFrame) -> DataFrame:
    """The same straight from review texts: counted per Arrow batch, so the (token, review) pairs are never grouped."""
    h = tf_histogram(reviews)
    return h.groupBy("token").agg(F.sum("n").alias("df"), F.sum(F.col("tf") * F.col("n")).alias("cf"))


def token_dictionary(stats: DataFrame) -> DataFrame:
    """(token_num, token, df, cf, token_length) in token order, numbers dense from 0, of (token, df, cf)."""
    d = dense_index(stats, [F.col("token")], "token_num")
    return d.select("token_num", "token", "df", "cf", F.length("token").cast("int").alias("token_length"))


def review_lengths(reviews: DataFrame) -> DataFrame:
    return reviews.select("review_id", token_count("text").alias("length"))


def review_table(raw: DataFrame) -> DataFrame:
    """Typed review attributes from text fields `score` and `helpfulness`; the score is cut towards zero."""
    h = F.split("helpfulness", "/")
    return raw.select(
        "review_id",
        "product_id",
        F.expr("cast(try_cast(score as float) as int)").alias("score"),
        F.try_element_at(h, F.lit(1)).try_cast("int").alias("helpfulness_num"),
        F.try_element_at(h, F.lit(2)).try_cast("int").alias("helpfulness_denom"),
        token_count("text").alias("length"),
    )


def product_spans(reviews: DataFrame) -> DataFrame:
    """(product_id, first_review_id, span_length, n_reviews); reviews without a product belong to none."""
    return (
        reviews.filter(F.col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(F.min("review_id").alias("first_review_id"), (F.count(F.lit(1)) - 1).alias("span_length"), F.count(F.lit(1)).alias("n_reviews"))
    )


def products(reviews: DataFrame) -> DataFrame:
    p = dense_index(product_spans(reviews), [F.col("product_id")], "product_num")
    return p.select("product_num", "product_id", "first_review_id", "span_length", "n_reviews")


def corpus_stats(reviews: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: n_reviews, n_tokens, n_distinct_tokens, n_products, with the (token, df, cf) of the reviews. Zeros for an
    empty corpus."""
    t = stats.agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("n_tokens"), F.count(F.lit(1)).alias("n_distinct_tokens"))
    r = reviews.agg(F.count(F.lit(1)).alias("n_reviews"))
    p = reviews.filter("product_id is not null").groupBy("product_id").agg(F.lit(1).alias("x")).agg(F.count(F.lit(1)).alias("n_products"))
    # three one-row tables side by side
    one = lambda d: d.withColumn("_k", F.lit(1))
    return one(r).join(one(t), "_k").join(one(p), "_k").select("n_reviews", "n_tokens", "n_distinct_tokens", "n_products")


def segment(review_id) -> F.Column:
    return F.floor(review_id / F.lit(SEGMENT)).cast("bigint")


def postings_flat(post: DataFrame) -> DataFrame:
    """(token, segment, postings): `id,tf,id,tf,…` ascending by id, one row per token and segment of ids."""
    g = post.groupBy("token", segment(F.col("review_id")).alias("segment")).agg(F.array_sort(F.collect_list(F.struct("review_id", "tf"))).alias("p"))
    flat = F.flatten(F.transform("p", lambda x: F.array(x["review_id"], x["tf"])))
    return g.select("token", "segment", F.array_join(flat.cast("array<string>"), ",").alias("postings"))


def flat_part(flat, part: str) -> F.Column:
    """Every other element of a flat `id,tf,…` list: the `ids` (places 0, 2, …) or the `frequencies` (places 1, 3, …)."""
    want = {"ids": 0, "frequencies": 1}[part]
    return F.filter(flat, lambda _, i: i % 2 == want)


def postings_gaps(post: DataFrame) -> DataFrame:
    """(token, review_id, gap, tf): the distance to the token's previous review, the first id kept.

    Gaps are taken inside (token, segment) groups; the first row of a segment looks up the last id of the segment
    before in a table of segment ends. A token in every review is thus spread over many tasks.
    """
    from pyspark.sql import Window

    s = post.withColumn("_s", segment(F.col("review_id")))
    w = Window.partitionBy("token", "_s").orderBy("review_id")
    inner = s.withColumn("_prev", F.lag("review_id").over(w))
    ends = s.groupBy("token", "_s").agg(F.max("review_id").alias("_end"))
    before = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy("token").orderBy("_s"))).filter("_before is not null").drop("_end")
    j = inner.join(before, ["token", "_s"], "left")
    gap = F.col("review_id") - F.coalesce("_prev", "_before", F.lit(0))
    return j.select("token", "review_id", gap.alias("gap"), "tf")


def gap_lists(gaps: DataFrame) -> DataFrame:
    """(token, segment, list): the (gap, tf) pairs of each token and segment in their order, the ids left out."""
    g = gaps.groupBy("token", segment(F.col("review_id")).alias("segment")).agg(F.array_sort(F.collect_list(F.struct("review_id", "gap", "tf"))).alias("l"))
    return g.select("token", "segment", F.transform("l", lambda x: F.struct(x["gap"].alias("gap"), x["tf"].alias("tf"))).alias("list"))


def gaps_to_ids(lists: DataFrame) -> DataFrame:
    """(token, review_id, tf) from gap lists (token, segment, list), by the places in the lists alone.

    Running sums inside each list, shifted by the sums of the token's segments before it.
    """
    from pyspark.sql import Window

    sums = lists.select("token", "segment", F.aggregate("list", F.lit(0).cast("bigint"), lambda a, x: a + x["gap"]).alias("_sum"))
    before = Window.partitionBy("token").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("token", "segment", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    rows = lists.select("token", "segment", F.posexplode("list").alias("pos", "x"))
    w = Window.partitionBy("token", "segment").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("_run", F.sum("x.gap").over(w))
    return run.join(base, ["token", "segment"]).select("token", (F.col("_run") + F.col("_base")).alias("review_id"), F.col("x.tf").alias("tf"))


def byte_offsets(coded: DataFrame) -> DataFrame:
    """(token, byte_offset, n_bytes): where each token's bytes begin in the concatenation in token order."""
    t = coded.groupBy("token").agg(F.sum("n_bytes").alias("n_bytes"))
    return global_prefix(t, [F.col("token")], {"byte_offset": F.col("n_bytes")}).select("token", "byte_offset", "n_bytes")
