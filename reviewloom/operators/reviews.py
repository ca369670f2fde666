"""Review rows as the rest of the library wants them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.session import measured_stash

#: Up to this many ids of repeated deliveries (8 bytes each, and two times) are broadcast.
REPEATED = 1_000_000


def _earliest(r: DataFrame) -> DataFrame:
    """The first row of each review_id by loaded_at, nulls first, by an exchange of the rows."""
    w = Window.partitionBy("review_id").orderBy("loaded_at")
    return r.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def current_reviews(reviews: DataFrame, *columns: str, repeated: int = REPEATED) -> DataFrame:
    """One row per review_id: the earliest delivery (a null time is the earliest; ties: any, deliveries being equal in all
    but loaded_at). Rows without a review_id are dropped.

    Only ids are exchanged, counted on the map side first: the ids that come more than once are kept as a table, and up to
    `repeated` of them are broadcast, so that all other rows, and the first of two deliveries, pass where they are read.
    Rows of ids that come three times, or twice at the same or an unknown time, are exchanged. With more repeated ids
    than may be broadcast, all rows are exchanged by review_id; with `repeated` 0 they are without counting, which is cheaper
    for rows without texts.
    """
    keep = [c for c in dict.fromkeys(columns) if c != "review_id"]
    r = reviews.filter(F.col("review_id").isNotNull()).select("review_id", "loaded_at", *[c for c in keep if c != "loaded_at"])
    if not repeated:
        return _earliest(r).select("review_id", *keep)
    many, seen = measured_stash(r.groupBy("review_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("review_id"), "repeated-ids", F.count(F.lit(1)).alias("n"))
    if seen["n"] == 0:
        return r.select("review_id", *keep)
    if seen["n"] > repeated:
        return _earliest(r).select("review_id", *keep)
    hits = r.select("review_id", "loaded_at").join(F.broadcast(many), "review_id")
    times = hits.groupBy("review_id").agg(F.count(F.lit(1)).alias("n"), F.count("loaded_at").alias("m"), F.min("loaded_at").alias("_first"), F.max("loaded_at").alias("last"))
    times = times.select("review_id", F.lit(True).alias("_again"), F.when(F.expr("n = 2 and m = 2 and _first < last"), F.col("_first")).alias("_first"))
    times, seen = measured_stash(times, "repeated-times", F.count_if(F.col("_first").isNull()).alias("n"))
    once = r.join(F.broadcast(times), "review_id", "left").filter("_again is null or loaded_at = _first").select("review_id", *keep)
    if seen["n"] == 0:
        return once
    others = times.filter("_first is null").select("review_id")
    return once.unionByName(_earliest(r.join(F.broadcast(others), "review_id")).select("review_id", *keep))
