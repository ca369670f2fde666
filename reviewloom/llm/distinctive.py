"""How characteristic each term is of its record: graph-of-words weight times collection rarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.arrow_tokens import encode_batch
from reviewloom.operators.term_counts import tf_histogram

WINDOW = 4
#: At most this many terms can each hold more than 1/HOT_TERMS of all (term, record) pairs; that table is broadcast.
HOT_TERMS = 65_536
#: Longer terms are never broadcast.
LONGEST = 64


def graph_degrees(row: np.ndarray, code: np.ndarray, n_codes: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, tf, degree) of each distinct term of each row.

    Two different terms are neighbours if they stand fewer than `window` places apart somewhere in the row; the degree is
    the number of distinct neighbours.
    """
    key = row * max(1, n_codes) + code
    uniq, inverse, tf = np.unique(key, return_inverse=True, return_counts=True)
    edges = []
    for d in range(1, window):
        a, b = inverse[:-d], inverse[d:]
        ok = (row[:-d] == row[d:]) & (a != b)
        a, b = a[ok], b[ok]
        edges += [a * len(uniq) + b, b * len(uniq) + a]
    degree = np.zeros(len(uniq), dtype=np.int64)
    if edges:
        e = np.concatenate(edges)
        e.sort()
        e = e[np.concatenate([[True], e[1:] != e[:-1]])] if len(e) else e
        degree = np.bincount(e // max(1, len(uniq)), minlength=len(uniq))
    return uniq // max(1, n_codes), uniq % max(1, n_codes), tf, degree


def _graph(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, code, words = encode_batch(b.column(1))
            r, c, tf, degree = graph_degrees(row, code, len(words), window)
            yield pa.record_batch([b.column(0).take(pa.array(r)), words.take(pa.array(c)).cast(pa.string()), pa.array(tf), pa.array(degree)], names=["review_id", "token", "tf", "degree"])

    return run


def term_graph(records: DataFrame, window: int = WINDOW) -> DataFrame:
    """(review_id, token, tf, degree), in one narrow pass."""
    return records.select("review_id", "text").mapInArrow(_graph(window), "review_id bigint, token string, tf bigint, degree bigint")


def distinctive_terms(records: DataFrame, window: int = WINDOW, hot_terms: int = HOT_TERMS) -> DataFrame:
    """(review_id, token, tf, degree, df, score) for every term of every record: score = degree · ln((N+1)/df).

    Each record must come once. Records without tokens give no rows; a one-term record scores 0 (no neighbours).

    The document frequencies reach the term rows in two ways: terms holding more than 1/hot_terms of all (term, record)
    pairs and no longer than LONGEST characters, at most hot_terms of them by counting, are broadcast (a few MB), so the bulk of the rows never moves; the rows of
    all other terms are joined by an exchange on the term, where no term has more than that share.
    """
    df = tf_histogram(records).groupBy("token").agg(F.sum("n").alias("df"))
    pairs = df.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("p")).scalar()
    n = records.agg(F.count(F.lit(1)).alias("n")).scalar()
    marked = df.withColumn("_hot", (F.col("df") * hot_terms > pairs) & (F.length("token") <= LONGEST))
    g = term_graph(records, window)
    hot = F.broadcast(marked.filter("_hot").select("token", "df"))
    hot_rows = g.join(hot, "token")
    rare = marked.filter("not _hot").select("token", "df")
    # rows of hot terms are dropped before the exchange
    rest = g.join(F.broadcast(marked.filter("_hot").select("token")), "token", "left_anti")
    out = hot_rows.unionByName(rest.join(rare, "token"))
    score = F.col("degree") * F.log((n + 1) / F.col("df"))
    return out.select("review_id", "token", "tf", "degree", "df", score.alias("score"))
