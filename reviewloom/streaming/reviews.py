"""Streaming forms: the same column expressions over a stream of review rows or dump records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.tokens import tokens
from reviewloom.sources.dump import parse_records


def parse_stream(records: DataFrame) -> DataFrame:
    """Typed fields from a stream with a `record` column."""
    return parse_records(records)


def first_deliveries(reviews: DataFrame, delay: str = "1 day", time: str = "loaded_at") -> DataFrame:
    """Drops repeated deliveries of a review_id inside the watermark, holding state for that time only."""
    return reviews.withWatermark(time, delay).dropDuplicatesWithinWatermark(["review_id"])


def token_counts(reviews: DataFrame, window: str = "1 hour", delay: str = "1 day", time: str = "loaded_at") -> DataFrame:
    """Occurrences per token and tumbling window; a window is final once the watermark passes it."""
    t = reviews.withWatermark(time, delay).select(time, F.explode(tokens("text")).alias("token"))
    return t.groupBy(F.window(time, window).alias("window"), "token").agg(F.count(F.lit(1)).alias("cf"))
