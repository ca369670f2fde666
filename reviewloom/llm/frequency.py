"""How often every term occurs in the collection, and in how many records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.arrow_tokens import encode_batch
from reviewloom.session import stash


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of the external sort: each batch's (term, record) pairs, sorted and run-length scanned."""
    for b in batches:
        row, code, words = encode_batch(b.column(0))
        if not len(row):
            continue
        rank = np.empty(len(words), dtype=np.int64)
        by_word = np.asarray(pc.array_sort_indices(words))
        rank[by_word] = np.arange(len(words))
        pairs = rank[code] * b.num_rows + row
        pairs.sort()
        term = pairs // b.num_rows
        at = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        new_pair = np.concatenate([[True], pairs[1:] != pairs[:-1]])
        cf = np.diff(np.append(at, len(term)))
        df = np.add.reduceat(new_pair.astype(np.int64), at)
        yield pa.record_batch([words.take(pa.array(by_word[term[at]])).cast(pa.string()), pa.array(df), pa.array(cf)], names=["token", "df", "cf"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan over rows sorted by token: sums neighbours, holding one open run between batches."""
    schema = pa.schema([("token", pa.string()), ("df", pa.int64()), ("cf", pa.int64())])
    open_: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = b.column(0)
        code = np.asarray(t.dictionary_encode().indices)
        at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        df = np.add.reduceat(np.asarray(b.column(1)), at)
        cf = np.add.reduceat(np.asarray(b.column(2)), at)
        tok = t.take(pa.array(at)).to_pylist()
        if open_ is not None:
            if tok[0] == open_[0]:
                df[0] += open_[1]
                cf[0] += open_[2]
            else:
                tok, df, cf = [open_[0], *tok], np.append(open_[1], df), np.append(open_[2], cf)
        open_ = (tok[-1], df[-1], cf[-1])
        if len(tok) > 1:
            yield pa.record_batch([pa.array(tok[:-1], pa.string()), pa.array(df[:-1]), pa.array(cf[:-1])], schema=schema)
    if open_ is not None:
        yield pa.record_batch([pa.array([open_[0]]), pa.array([open_[1]], pa.int64()), pa.array([open_[2]], pa.int64())], schema=schema)


def merge_runs(runs: DataFrame) -> DataFrame:
    """(token, df, cf) from partial counts: range-partitioned external sort by token, then one scan of runs.

    The partial counts are written once, so that sampling the ranges doesn't run the scan that made them again. Rows
    with a null token are dropped.
    """
    r = stash(runs.filter("token is not null"), "term-runs")
    return r.repartitionByRange("token").sortWithinPartitions("token").mapInArrow(_merge, "token string, df bigint, cf bigint")


def term_frequencies(records: DataFrame, text: str = "text") -> DataFrame:
    """(token, df, cf) over all texts, one row per token.

    Each record must come once (see current_reviews). Null and empty texts add nothing; an empty table gives no rows.
    Pairs are counted per Arrow batch before anything is exchanged: a term in every record sends one row per batch.
    """
    return merge_runs(records.select(F.col(text).alias("t")).mapInArrow(_runs, "token string, df bigint, cf bigint"))


def mark_terms(freq: DataFrame, n_records, rare: int = 2, common: float = 0.1) -> DataFrame:
    """Adds mark: `rare` in at most `rare` records, `common` in more than the share `common` of all records, else null."""
    per = round(1 / common)
    mark = F.when(F.col("df") <= rare, "rare").when(F.col("df") * per > n_records, "common")
    return freq.withColumn("mark", mark)
