"""The N best rows of every group, streamed from sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _changed(a: pa.Array, last) -> np.ndarray:
    """Whether each value differs from the one before it (nulls equal each other)."""
    out = np.ones(len(a), dtype=bool)
    d = a.dictionary_encode(null_encoding="encode")
    c = np.asarray(d.indices)
    out[1:] = c[1:] != c[:-1]
    if last is not None:
        out[0] = a[0].as_py() != last[0]
    return out


def _first_n(n: int, n_group: int):
    """Scanner over batches sorted by group, order and item; holds the last row's group and item and one counter.

    Rows of the same group and item are deliveries of one item and count once; sorted, they are neighbours.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_group: list | None = None
        last_item = None
        count = 0
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, dtype=bool)
            for i in range(n_group):
                new |= _changed(b.column(i), None if last_group is None else (last_group[i],))
            item = _changed(b.column(b.num_columns - 1), None if last_item is None else (last_item[0],))
            fresh = new | item
            total = np.cumsum(fresh)
            # the running count at the start of each row's group; the first group goes on from the last batch
            at = np.where(new, total - 1, -count)
            base = np.maximum.accumulate(np.where(new, at, -count if not new[0] else 0))
            rank = total - base
            yield b.filter(pa.array(fresh & (rank <= n)))
            last_group = [b.column(i)[b.num_rows - 1].as_py() for i in range(n_group)]
            last_item = (b.column(b.num_columns - 1)[b.num_rows - 1].as_py(),)
            count = int(rank[-1])

    return scan


def top_items(df: DataFrame, group: list[str], order: list[Column], item: str, n: int = 3) -> DataFrame:
    """(group…, item): the first n distinct items of each group by `order`, then by item ascending.

    Secondary sort in two steps. Every input partition is sorted by group, order and item, and streamed for its own first
    n of each group; only those rows are hash-partitioned by group, sorted and streamed again. A group of any size
    thus sends at most n rows per input partition, and no step holds a group. Rows with the same group and item must
    be equal in `order` (repeated deliveries): they count once. A null in a group column is a group of its own; an
    empty table gives an empty table; columns of any other name are ignored.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    g = [f"_g{i}" for i in range(len(group))]
    o = [f"_o{i}" for i in range(len(order))]
    # order columns become plain ones, ascending flags kept apart
    rows = df.select(*[F.col(c).alias(a) for c, a in zip(group, g)], *[c.alias(a) for c, a in zip(order, o)], F.col(item).alias("_item"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    by = [*[F.col(c) for c in g], *[F.col(c).desc() for c in o], F.col("_item").asc()]
    scan = _first_n(n, len(g))
    part = rows.sortWithinPartitions(*by).mapInArrow(scan, schema)
    full = part.repartition(*g).sortWithinPartitions(*by).mapInArrow(scan, schema)
    return full.select(*[F.col(a).alias(c) for c, a in zip(group, g)], *[F.col(c) for c in o], F.col("_item").alias(item))
