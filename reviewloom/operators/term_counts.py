"""Token counts over Arrow batches: per review, and combined on the map side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.arrow_tokens import encode_batch, row_token_counts


def _tf_histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, code, words = encode_batch(b.column(0))
        _, c, tf = row_token_counts(row, code, len(words))
        width = int(tf.max()) + 1 if len(tf) else 1
        pair, n = np.unique(c * width + tf, return_counts=True)
        yield pa.record_batch([words.take(pa.array(pair // width)).cast(pa.string()), pa.array(pair % width), pa.array(n)], names=["token", "tf", "n"])


def tf_histogram(reviews: DataFrame) -> DataFrame:
    """(token, tf, n): in how many reviews a token occurs tf times; df = Σn and cf = Σ tf·n.

    Each Arrow batch sends its distinct (token, tf) pairs only, which the partial aggregate merges per task: a token in
    every review moves a few rows per task. Reviews without tokens add nothing.
    """
    h = reviews.select("text").mapInArrow(_tf_histogram, "token string, tf bigint, n bigint")
    return h.groupBy("token", "tf").agg(F.sum("n").alias("n"))


def _review_terms(only: tuple[str, ...] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, code, words = encode_batch(b.column(1))
            if only is not None and len(row):
                wanted = np.asarray(pc.is_in(words, value_set=pa.array(only, words.type)))[code]
                row, code = row[wanted], code[wanted]
            r, c, tf = row_token_counts(row, code, len(words))
            yield pa.record_batch([words.take(pa.array(c)).cast(pa.string()), b.column(0).take(pa.array(r)), pa.array(tf)], names=["token", "review_id", "tf"])

    return run


def review_terms(reviews: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """(token, review_id, tf) of reviews that come once each, counted where they are read: a review's tokens stand in one
    row, so nothing is exchanged. `only` restricts the tokens before they leave the batch."""
    return reviews.select("review_id", "text").mapInArrow(_review_terms(only), "token string, review_id bigint, tf bigint")
