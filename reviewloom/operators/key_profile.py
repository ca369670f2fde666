"""Counts, means and exact quantiles per key, and the hot keys themselves, when a few keys hold most rows.

Distributed exact selection: a hot key's values are never gathered. Each round counts the values between the current
bounds of every unresolved (key, rank) in a fixed number of bins; counts, minima and maxima of bins are mergeable,
so each task sends at most bounds x bins rows. The bin holding the wanted rank gives the next bounds; ranks in the same
bin go on with the same bounds. A rank is resolved when its bin's minimum equals its maximum. The minimum and the maximum
always fall in different bins, so every round narrows the bounds.

Keys with more than 1/hot_share of all values, or more than `most` of them, are hot. There are fewer than
max(hot_share, rows / most) of them, which bounds the bounds table that is broadcast and collected each round. All other
keys go through one histogram of (key, value): a task orders at most `most` values of a key.

Hot keys are found by the same selection over hashes of the keys: a key with more than 1/share of the weight holds
one of `share` evenly spaced ranks, so the keys of these ranks, and no others, need counting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 64
HOT_SHARE = 1024
#: A cold key has at most this many values.
MOST = 1 << 24


def key_profile(rows: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9), hot_share: int = HOT_SHARE, bins: int = BINS, most: int = MOST) -> DataFrame:
    """(key, n, total, mean, q0, q1, …) from rows (key, value, weight); the quantile is the value of rank ceil(q·n).

    weight is the number of equal rows a row stands for (null: 1). Null, NaN and infinite values count in n, but in
    no other figure; a key without any other value has null total, mean and quantiles. A null key is a key like any
    other. Values are compared as doubles. `rows` is read once per round, so it should be a table or a stash. Without
    quantiles there are no rounds: one aggregate gives the rest.
    """
    if not all(0 <= q <= 1 for q in quantiles):
        raise ValueError("quantiles lie between 0 and 1")
    if bins < 2:
        raise ValueError("at least 2 bins")
    v = F.col("value").cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    r = rows.select("key", F.when(finite, v).alias("v"), F.coalesce(F.col("weight").cast("bigint"), F.lit(1)).alias("w"))
    stats = r.groupBy("key").agg(
        F.sum("w").alias("n"),
        F.sum(F.when(F.col("v").isNotNull(), F.col("w"))).alias("m"),
        F.sum(F.col("v") * F.col("w")).alias("total"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
    )
    out = stats.select("key", "n", "total", (F.col("total") / F.col("m")).alias("mean"))
    if not quantiles:
        return out
    all_values = stats.agg(F.coalesce(F.sum("m"), F.lit(0))).head()[0]
    limit = min(all_values // hot_share, most)
    ranks = F.array(*[F.greatest(F.ceil(F.lit(float(q)) * F.col("m")), F.lit(1)).cast("bigint") for q in quantiles]).alias("ranks")
    # at most all_values / limit keys can exceed the limit
    hot = stats.filter(F.col("m") > limit).select("key", "lo", "hi", ranks).collect()
    hot_keys = {x["key"] for x in hot}
    found = _select(r, {x["key"]: (x["lo"], x["hi"], x["ranks"]) for x in hot}, bins)
    spark = rows.sparkSession
    kt = rows.schema["key"].dataType.simpleString()
    q_names = [f"q{i}" for i in range(len(quantiles))]
    hot_df = spark.createDataFrame([(k, *[found[k, i] for i in range(len(quantiles))]) for k in hot_keys], f"key {kt}, " + ", ".join(f"{q} double" for q in q_names))

    hot_only = F.broadcast(hot_df.select("key").withColumnRenamed("key", "_hot"))
    cold = r.filter("v is not null").join(hot_only, F.col("key").eqNullSafe(F.col("_hot")), "left_anti")
    hist = cold.groupBy("key", "v").agg(F.sum("w").alias("w"))
    by_key = Window.partitionBy("key")
    cum = F.sum("w").over(by_key.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = hist.select("key", "v", cum.alias("cum"), F.sum("w").over(by_key).alias("m"))
    wanted = [F.min(F.when(F.col("cum") >= F.greatest(F.ceil(F.lit(float(q)) * F.col("m")), F.lit(1)), F.col("v"))).alias(n) for q, n in zip(quantiles, q_names)]
    cold_q = ranked.groupBy("key").agg(*wanted)
    qs = cold_q.unionByName(hot_df).withColumnRenamed("key", "_k")
    return out.join(qs, F.col("key").eqNullSafe(F.col("_k")), "left").drop("_k")


def _select(r: DataFrame, wanted: dict, bins: int) -> dict[tuple, float]:
    """{(key, number): value} of wanted {key: (least, greatest value, ranks)}, over rows (key, v, w)."""
    spark = r.sparkSession
    kt = r.schema["key"].dataType.simpleString()
    state = {(k, lo, hi): [(i, rank) for i, rank in enumerate(ranks)] for k, (lo, hi, ranks) in wanted.items()}
    found: dict[tuple, float] = {}
    while True:
        for k, lo, hi in [x for x in state if x[1] == x[2]]:
            found |= {(k, i): lo for i, _ in state.pop((k, lo, hi))}
        if not state:
            return found
        # bounds of a key are equal or don't overlap: a row falls within one of them at most
        bounds = list(state)
        at = spark.createDataFrame([(i, *b) for i, b in enumerate(bounds)], f"_i int, _k {kt}, lo double, hi double")
        j = r.join(F.broadcast(at), F.col("key").eqNullSafe(F.col("_k")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        width = F.col("hi") - F.col("lo")
        part = F.when(width < float("inf"), (F.col("v") - F.col("lo")) / width).otherwise((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2))
        b = F.least(F.floor(part * bins), F.lit(bins - 1)).alias("bin")
        counts = j.groupBy("_i", b).agg(F.sum("w").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        by_bounds: dict[int, list] = {}
        for x in counts.collect():  # at most len(bounds) x bins rows
            by_bounds.setdefault(x["_i"], []).append((x["bin"], x["w"], x["lo"], x["hi"]))
        new: dict[tuple, list] = {}
        for i, rows in by_bounds.items():
            todo, before = sorted(state[bounds[i]], key=lambda t: t[1]), 0
            for _, w, lo, hi in sorted(rows):
                while todo and todo[0][1] <= before + w:
                    number, rank = todo.pop(0)
                    new.setdefault((bounds[i][0], lo, hi), []).append((number, rank - before))
                before += w
        state = new


def hot_keys(rows: DataFrame, share: int, bins: int = 1024) -> DataFrame:
    """(key, weight) of the non-null keys with more than 1/share of the weight of all rows (key, weight), null keys' included.

    No key is grouped to find them: exact selection gives the hashes at `share` evenly spaced ranks, and only rows with
    these hashes, at most `share` of them, are counted by key. `rows` is read once per round.
    """
    r = rows.select("key", F.coalesce(F.col("weight").cast("bigint"), F.lit(1)).alias("w"))
    hashed = r.select("key", "w", F.xxhash64("key").alias("h"))
    # 52 bits of the hash, which a double holds exactly, and of these the upper ten
    v = F.shiftrightunsigned("h", 12).cast("double")
    hashed = hashed.select(F.when(F.col("key").isNotNull(), F.shiftrightunsigned("h", 54).cast("int")).alias("key"), v.alias("v"), "w", F.col("key").alias("of"))
    first = hashed.groupBy("key").agg(F.sum("w").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()  # at most 1,025 rows
    total = sum(x["w"] for x in first)
    # so close that a key with more than 1/share of the total cannot lie between two of them
    step = total // share + 1
    wanted, before = {}, 0
    for x in sorted((x for x in first if x["key"] is not None), key=lambda x: x["key"]):
        ranks = range(-before % step or step, x["w"] + 1, step)
        if ranks:
            wanted[x["key"]] = (x["lo"], x["hi"], list(ranks))
        before += x["w"]
    found = set(_select(hashed, wanted, bins).values())
    known = hashed.filter("key is not null").select(F.col("of").alias("key"), "v", "w")
    hot = known.filter(F.col("v").isin(sorted(found))) if found else known.filter(F.lit(False))
    return hot.groupBy("key").agg(F.sum("w").alias("weight")).filter(F.col("weight") * share > total)


def keyed_lists(rows: DataFrame, key: str, item: str, span: int = 65_536) -> DataFrame:
    """(key, segment, items): the ascending distinct integers of each key, in segments of `span` consecutive values.

    A segment holds at most `span` items however many the key has, so no task gathers a hot key. Null keys or items
    give no row.
    """
    r = rows.filter(F.col(key).isNotNull() & F.col(item).isNotNull()).select(F.col(key).alias("key"), F.col(item).cast("bigint").alias("item"))
    g = r.groupBy("key", F.floor(F.col("item") / span).alias("segment")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    return g.select("key", "segment", "items")
