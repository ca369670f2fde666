"""Point lookups, one probe at a time or for a whole table of probes.

Batch forms left-join a probe table, so absent keys give the documented sentinels: null product, -1 for review
attributes, 0 for token counts, no rows for lists. The join strategy is left to Catalyst: small probe tables are
broadcast under the session's size limit, large ones are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.tokens import fold

ATTRIBUTES = ("score", "helpfulness_num", "helpfulness_denom", "length")


def review_attributes(probes: DataFrame, reviews: DataFrame) -> DataFrame:
    """(probe, score, helpfulness_num, helpfulness_denom, length); -1 for an absent review or a null attribute."""
    r = reviews.select(F.col("review_id").alias("probe"), *ATTRIBUTES)
    return probes.select("probe").join(r, "probe", "left").select("probe", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ATTRIBUTES])


def review_products(probes: DataFrame, reviews: DataFrame) -> DataFrame:
    r = reviews.select(F.col("review_id").alias("probe"), "product_id")
    return probes.select("probe").join(r, "probe", "left").select("probe", "product_id")


def token_frequencies(probes: DataFrame, tokens: DataFrame) -> DataFrame:
    """(probe, df, cf); the probe is lower-cased, not split."""
    t = tokens.select(F.col("token").alias("_t"), "df", "cf")
    j = probes.select("probe").join(t, fold("probe") == F.col("_t"), "left")
    return j.select("probe", F.coalesce("df", F.lit(0)).alias("df"), F.coalesce("cf", F.lit(0)).alias("cf"))


def token_numbers(probes: DataFrame, tokens: DataFrame) -> DataFrame:
    t = tokens.select(F.col("token").alias("_t"), "token_num")
    j = probes.select("probe").join(t, fold("probe") == F.col("_t"), "left")
    return j.select("probe", F.coalesce("token_num", F.lit(-1)).alias("token_num"))


def token_postings(probes: DataFrame, post: DataFrame) -> DataFrame:
    """(probe, review_id, tf). A semi-join goes before the join: Catalyst can put it below the aggregate that makes
    postings from texts, so that only the probed tokens are grouped."""
    wanted = probes.select(fold("probe").alias("token")).distinct()
    p = post.join(wanted, "token", "left_semi").select(F.col("token").alias("_t"), "review_id", "tf")
    return probes.select("probe").join(p, fold("probe") == F.col("_t")).select("probe", "review_id", "tf")


def product_reviews(probes: DataFrame, reviews: DataFrame) -> DataFrame:
    """(probe, review_id) by true grouping; the product id is case-sensitive."""
    r = reviews.select(F.col("product_id").alias("probe"), "review_id")
    return probes.select("probe").join(r, "probe").select("probe", "review_id")


def product_reviews_range(probes: DataFrame, spans: DataFrame) -> DataFrame:
    """(probe, review_id) as the range first..first+span, right only for contiguous products."""
    s = spans.select(F.col("product_id").alias("probe"), "first_review_id", "span_length")
    ids = F.explode(F.sequence(F.col("first_review_id"), F.col("first_review_id") + F.col("span_length")))
    return probes.select("probe").join(s, "probe").select("probe", ids.alias("review_id"))


class ReviewLookup:
    """The eleven getters over index tables (DataFrames `reviews`, `products`, `tokens`, `postings`).

    A getter filters on its key, so over the persisted index the Parquet min/max statistics of the sorted files
    prune all but the row groups that can hold it.
    """

    def __init__(self, reviews: DataFrame, products: DataFrame, tokens: DataFrame, postings: DataFrame):
        self.reviews, self.products, self.tokens, self.postings = reviews, products, tokens, postings

    def _review(self, review_id: int, column: str):
        row = self.reviews.filter(F.col("review_id") == F.lit(review_id)).select(column).head()
        return None if row is None else row[0]

    def product_id(self, review_id: int) -> str | None:
        return self._review(review_id, "product_id")

    def _attribute(self, review_id: int, column: str) -> int:
        v = self._review(review_id, column)
        return -1 if v is None else v

    def review_score(self, review_id: int) -> int:
        return self._attribute(review_id, "score")

    def review_helpfulness_numerator(self, review_id: int) -> int:
        return self._attribute(review_id, "helpfulness_num")

    def review_helpfulness_denominator(self, review_id: int) -> int:
        return self._attribute(review_id, "helpfulness_denom")

    def review_length(self, review_id: int) -> int:
        return self._attribute(review_id, "length")

    def _token(self, token: str, column: str) -> int:
        row = self.tokens.filter(F.col("token") == F.lower(F.lit(token))).select(column).head()
        return 0 if row is None else row[0]

    def token_frequency(self, token: str) -> int:
        return self._token(token, "df")

    def token_collection_frequency(self, token: str) -> int:
        return self._token(token, "cf")

    def reviews_with_token(self, token: str) -> DataFrame:
        """(review_id, tf) ascending by id; empty for an absent token."""
        return self.postings.filter(F.col("token") == F.lower(F.lit(token))).select("review_id", "tf").orderBy("review_id")

    def number_of_reviews(self) -> int:
        return self.reviews.count()

    def token_size_of_reviews(self) -> int:
        return self.tokens.agg(F.coalesce(F.sum("cf"), F.lit(0))).head()[0]

    def product_reviews(self, product_id: str) -> DataFrame:
        """review_id ascending; empty for an absent product."""
        return self.reviews.filter(F.col("product_id") == F.lit(product_id)).select("review_id").orderBy("review_id")
