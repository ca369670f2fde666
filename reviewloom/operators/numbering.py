"""Dense numbers and running sums over a global order, without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.session import cut


def global_prefix(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, per name, the sum of its column over all rows before this one in `order` (exclusive).

    Rows are range-partitioned, summed inside each partition, and shifted by the totals of the partitions before it.
    Only one row per partition reaches the driver. The range-partitioned rows are checkpointed first, because
    both passes must see the same partitions. Ties in `order` get an arbitrary but dense order. Empty input gives
    empty output.
    """
    s = df.repartitionByRange(*order).sortWithinPartitions(*order)
    s = s.withColumn("_pid", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id())
    for k, v in sums.items():
        s = s.withColumn(f"_v_{k}", v.cast("bigint"))
    s = cut(s)
    totals = s.groupBy("_pid").agg(*[F.sum(f"_v_{k}").alias(k) for k in sums]).orderBy("_pid").collect()
    base: list[tuple] = []
    run = dict.fromkeys(sums, 0)
    for t in totals:
        base.append((t["_pid"], *[run[k] for k in sums]))
        run = {k: run[k] + (t[k] or 0) for k in sums}
    schema = "_pid int" + "".join(f", _b_{k} bigint" for k in sums)
    offsets = df.sparkSession.createDataFrame(base, schema)
    w = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    for k in sums:
        s = s.withColumn(f"_i_{k}", F.coalesce(F.sum(f"_v_{k}").over(w), F.lit(0)))
    s = s.join(F.broadcast(offsets), "_pid")  # one row per partition
    for k in sums:
        s = s.withColumn(k, F.col(f"_i_{k}") + F.col(f"_b_{k}"))
    drop = [f"_{p}_{k}" for k in sums for p in "vib"]
    return s.drop("_pid", "_pos", *drop)


def dense_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """0-based dense rank of distinct rows in `order`."""
    return global_prefix(df, order, {name: F.lit(1)})
