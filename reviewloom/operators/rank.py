"""Ranked search over reviews and products."""

from __future__ import annotations

import dataclasses

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.arrow_tokens import tokenize_batch
from reviewloom.functions.tokens import tokens
from reviewloom.operators.build import postings
from reviewloom.operators.numbering import dense_index


@dataclasses.dataclass(frozen=True)
class RankParams:
    """alpha: weight of relevance against quality. scale: factor that brings relevance to quality's size.

    half: share of the length in a review's weight. digits: places kept before ranking, so that the order of a
    floating-point sum cannot turn a tie into an order. quality: how reviews combine ("mean", "sum" or
    "weighted_mean"). scheme: "lnn.ltc" or "nnn.ntn".
    """

    alpha: float = 0.7
    scale: float = 5.0
    half: float = 0.5
    digits: int = 12
    quality: str = "mean"
    scheme: str = "lnn.ltc"
    k: int = 10


def query_terms(spark, query: str) -> DataFrame:
    """(token, q_tf) of a query text; the number of rows is bounded by the query's own length."""
    return spark.createDataFrame([(query,)], "q string").select(F.explode(tokens("q")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("q_tf"))


def query_tokens(query: str) -> tuple[str, ...]:
    return tuple(sorted(set(tokenize_batch(pa.array([query]))[1].to_pylist())))


def matching_postings(query: str, reviews: DataFrame) -> DataFrame:
    """The postings of the query's terms only; no other term leaves the batch it is read in."""
    return postings(reviews, query_tokens(query))


def vector_space_search(query: str, post: DataFrame, stats: DataFrame, n_reviews: int, p: RankParams = RankParams()) -> DataFrame:
    """(review_id, score, rank) of every review sharing a term with the query, best first, ties by id.

    Documents weigh 1+log10(tf) without normalisation, query terms (1+log10 tf)·log10(N/df), cosine-normalised over
    the terms the collection knows. No known term: no rows.
    """
    spark = post.sparkSession
    terms = query_terms(spark, query)
    known = F.broadcast(terms).join(stats.select("token", "df"), "token")
    if p.scheme == "lnn.ltc":
        qw: Column = (1 + F.log10("q_tf")) * F.log10(F.lit(float(n_reviews)) / F.col("df"))
        dw: Column = 1 + F.log10("tf")
    elif p.scheme == "nnn.ntn":
        qw, dw = F.col("q_tf") * F.log10(F.lit(float(n_reviews)) / F.col("df")), F.col("tf").cast("double")
    else:
        raise ValueError(f"unknown scheme {p.scheme!r}")
    # the query's terms: a handful of rows, in one partition
    known = known.select("token", qw.alias("w")).coalesce(1)
    if p.scheme == "lnn.ltc":
        from pyspark.sql import Window

        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(F.lit(1))))
        known = known.select("token", F.when(norm > 0, F.col("w") / norm).otherwise(0.0).alias("w"))
    hits = post.join(F.broadcast(known), "token").groupBy("review_id").agg(F.round(F.sum(F.col("w") * dw), p.digits).alias("score"))
    r = dense_index(hits, [F.col("score").desc(), F.col("review_id").asc()], "_n")
    return r.select("review_id", "score", (F.col("_n") + 1).alias("rank"))


def review_weights(reviews: DataFrame, p: RankParams = RankParams()) -> DataFrame:
    """(review_id, product_id, score, helpfulness_norm, length_norm, weight).

    helpfulness_norm = num/denom · denom/max denom of the product, length_norm = length/max length of the product,
    both 0 where the divisor is 0 or null. The maxima come from a map-side combined aggregate joined back, not from
    a window, so a product with very many reviews is not gathered in one task (AQE splits a skewed join).
    Reviews without a product have none of these and are left out.
    """
    r = reviews.filter("product_id is not null").select("review_id", "product_id", "score", "helpfulness_num", "helpfulness_denom", "length")
    m = r.groupBy("product_id").agg(F.max("helpfulness_denom").alias("_md"), F.max("length").alias("_ml"))
    j = r.join(m, "product_id")
    num, den = F.col("helpfulness_num").cast("double"), F.col("helpfulness_denom").cast("double")
    h = F.when((den > 0) & (F.col("_md") > 0), F.coalesce(num / den * (den / F.col("_md")), F.lit(0.0))).otherwise(0.0)
    ln = F.when(F.col("_ml") > 0, F.coalesce(F.col("length").cast("double") / F.col("_ml"), F.lit(0.0))).otherwise(0.0)
    j = j.withColumn("helpfulness_norm", h).withColumn("length_norm", ln)
    w = p.half * F.col("length_norm") + (1 - p.half) * F.col("helpfulness_norm")
    return j.select("review_id", "product_id", "score", "helpfulness_norm", "length_norm", w.alias("weight"))


def product_quality(reviews: DataFrame, p: RankParams = RankParams()) -> DataFrame:
    """(product_id, quality): mean of weight·score times ln(number of reviews + 1); a null score counts as 0.

    The maxima that normalise the weights are the same for all reviews of a product, so they leave the sums:
    Σ weight·score = half·Σ(score·length)/max length + (1-half)·Σ(score·num)/max denom. One map-side combined
    aggregate over exact integer sums gives everything, without joining reviews to their maxima.
    """
    s = F.coalesce(F.col("score"), F.lit(0)).cast("bigint")
    num = F.when(F.col("helpfulness_denom") > 0, F.coalesce("helpfulness_num", F.lit(0)).cast("bigint")).otherwise(F.lit(0))
    length = F.coalesce(F.col("length"), F.lit(0))
    g = (
        reviews.filter("product_id is not null")
        .groupBy("product_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("length").alias("ml"),
            F.max("helpfulness_denom").alias("md"),
            F.sum(s * length).alias("sl"),
            F.sum(s * num).alias("sh"),
            F.sum(length).alias("l"),
            F.sum(num).alias("h"),
        )
    )
    per = lambda x, most: F.when(F.col(most) > 0, F.col(x).cast("double") / F.col(most)).otherwise(0.0)
    ws = p.half * per("sl", "ml") + (1 - p.half) * per("sh", "md")
    w = p.half * per("l", "ml") + (1 - p.half) * per("h", "md")
    how = {"mean": ws / F.col("n"), "sum": ws, "weighted_mean": F.when(w > 0, ws / w).otherwise(0.0)}[p.quality]
    return g.select("product_id", (how * F.log(F.col("n") + 1)).alias("quality"))


def product_relevance(hits: DataFrame, weights: DataFrame, p: RankParams = RankParams()) -> DataFrame:
    """(product_id, relevance): sum over hits of weight · scale / rank."""
    j = hits.select("review_id", "rank").join(weights.select("review_id", "product_id", "weight"), "review_id")
    return j.groupBy("product_id").agg(F.sum(F.col("weight") * p.scale / F.col("rank")).alias("relevance"))


def product_rank(relevance: DataFrame, quality: DataFrame, p: RankParams = RankParams()) -> DataFrame:
    """(product_id, quality, relevance, rank_value) of the products with a hit."""
    v = p.alpha * F.col("relevance") + (1 - p.alpha) * F.col("quality")
    return relevance.join(quality, "product_id").select("product_id", "quality", "relevance", v.alias("rank_value"))


def product_search(ranked: DataFrame, p: RankParams = RankParams()) -> DataFrame:
    """The k best products, ties by product id ascending."""
    v = F.round("rank_value", p.digits)
    return ranked.orderBy(v.desc(), F.col("product_id").asc()).limit(p.k).select("product_id", "rank_value")
