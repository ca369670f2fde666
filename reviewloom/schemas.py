"""Explicit schemas of the index tables; nothing is inferred."""

from pyspark.sql import types as T

REVIEWS = T.StructType(
    [
        T.StructField("review_id", T.LongType(), False),
        T.StructField("product_id", T.StringType()),
        T.StructField("product_num", T.LongType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("helpfulness_num", T.IntegerType()),
        T.StructField("helpfulness_denom", T.IntegerType()),
        T.StructField("length", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)
PRODUCTS = T.StructType(
    [
        T.StructField("product_num", T.LongType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("first_review_id", T.LongType()),
        T.StructField("span_length", T.LongType()),
        T.StructField("n_reviews", T.LongType()),
    ]
)
TOKENS = T.StructType(
    [
        T.StructField("token_num", T.LongType()),
        T.StructField("token", T.StringType()),
        T.StructField("df", T.LongType()),
        T.StructField("cf", T.LongType()),
        T.StructField("token_length", T.IntegerType()),
    ]
)
POSTINGS = T.StructType(
    [
        T.StructField("token", T.StringType()),
        T.StructField("review_id", T.LongType()),
        T.StructField("tf", T.LongType()),
    ]
)
