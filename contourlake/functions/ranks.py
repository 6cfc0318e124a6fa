"""Exact order statistics of a whole column without one big sort or one big group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A


def _cuts(counts: DataFrame, buckets: int) -> Column | None:
    """Array of at most ``buckets - 1`` values that split the distinct values evenly.

    Numbers are cut at approximate quantiles, values of any other ordered type at a sample drawn by hash.
    """
    if isinstance(counts.schema["value"].dataType, T.NumericType):
        probs = [i / buckets for i in range(1, buckets)]
        cuts = sorted(set(counts.approxQuantile("value", probs, 0.002))) if probs else []
        return A.dlit(cuts) if cuts else None
    drawn = counts.orderBy(F.xxhash64("value"), "value").limit(buckets - 1).select("value").collect()
    return F.array(*[F.lit(r["value"]) for r in drawn]) if drawn else None


def value_ranks(df: DataFrame, col: str, buckets: int = 256) -> DataFrame:
    """Distinct values of an ordered column with counts and exact cumulative counts: (value, n, cum).

    Values are first counted with partial aggregation, so a heavy value is one row.  The distinct values are
    split at boundaries (fewer than ``buckets`` values on the driver); each bucket accumulates on its own and
    adds the total of the buckets before it.  Any boundaries give the same result.  Nulls are not ranked.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    cuts = _cuts(counts, buckets)
    bucket = F.lit(0) if cuts is None else F.size(F.filter(cuts, lambda b: b < F.col("value")))
    placed = counts.withColumn("bucket", bucket)
    running = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    before = (
        placed.groupBy("bucket")
        .agg(F.sum("n").alias("t"))
        .select("bucket", (F.sum("t").over(running) - F.col("t")).alias("before"))
    )
    within = F.sum("n").over(W.partitionBy("bucket").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    return (
        placed.withColumn("within", within)
        .join(F.broadcast(before), "bucket")
        .select("value", "n", (F.col("before") + F.col("within")).alias("cum"))
    )


def exact_percentiles(df: DataFrame, col: str, percents: Sequence[float]) -> DataFrame:
    """Linear-interpolated percentiles of a whole column as one row (p10, p25, ...)."""
    total = df.agg(F.count(col).alias("total"))
    r = value_ranks(df, col).join(F.broadcast(total))
    aggs = []
    for p in percents:
        pos = (F.col("total") - 1) * (float(p) / 100.0)
        lo = F.floor(pos)
        a = F.min(F.when(F.col("cum") > lo, F.col("value")))
        b = F.min(F.when(F.col("cum") > F.ceil(pos), F.col("value")))
        w = F.max(pos - lo)
        aggs.append((a + (b - a) * w).alias(f"p{p:g}"))
    return r.agg(*aggs)


def positive_medians(df: DataFrame, col: str, key: str = "call_id", parts: int = 32) -> DataFrame:
    """Exact median of the values above 0 per key: (key, median); keys without one are absent.

    Selection by counting: a histogram over ``parts`` ranges an octave, combined per task, tells which range holds
    the middle ranks; only the values of that range are counted one by one.  No task keeps the values of a key.
    """
    v = F.col(col)
    odd = F.isnan(v) | (v == float("inf"))  # behind all ranges
    cells = df.filter(v > 0).select(key, v.alias("v"), F.when(odd, F.lit(1 << 20)).otherwise(F.floor(F.log2(v) * parts)).cast("int").alias("range"))
    hist = cells.groupBy(key, "range").agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy(key)
    upto = F.sum("n").over(by.orderBy("range").rowsBetween(W.unboundedPreceding, 0))
    placed = hist.select(key, "range", "n", (upto - F.col("n")).alias("before"), F.sum("n").over(by).alias("total"))
    ranked = placed.withColumn("lo", F.floor((F.col("total") - 1) / 2)).withColumn("hi", F.floor(F.col("total") / 2))
    held = ranked.filter("before <= hi and before + n > lo").select(key, "range", "before", "lo", "hi")
    single = cells.join(held, [key, "range"]).groupBy(key, "range", "before", "lo", "hi", "v").agg(F.count(F.lit(1)).alias("n"))
    within = F.sum("n").over(W.partitionBy(key, "range").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    cum = single.withColumn("cum", F.col("before") + within)
    at = lambda rank: F.min(F.when(F.col("cum") > F.col(rank), F.col("v")))
    return cum.groupBy(key).agg(((at("lo") + at("hi")) / 2).alias("median"))
