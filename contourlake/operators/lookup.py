"""Joins and lookups along contours and grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import exprs as X


def join_calls(contour: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matched rows, and the calls of ``contour`` without a partner."""
    have = other.select("call_id").distinct()
    return contour.join(other, "call_id"), contour.select("call_id").distinct().join(have, "call_id", "left_anti")


def nearest_index(axis: Column, x: Column) -> Column:
    """Position of the nearest axis value, the lower one on ties; values outside map to the ends."""
    return F.array_min(F.transform(axis, lambda v, i: F.struct(F.abs(v - x).alias("d"), i.alias("i"))))["i"]


def nearest(df: DataFrame, axis: Sequence[float], col: str, out: str = "idx") -> DataFrame:
    """Nearest value of a configuration-sized axis; an unsorted axis is sorted first."""
    return df.withColumn(out, nearest_index(A.dlit(sorted(axis)), F.col(col)))


def bracket(df: DataFrame, axis: DataFrame, x: Column, axis_x: Column, *values: Column) -> DataFrame:
    """Rows of ``df`` with ``_b`` and ``_a``: the call's last axis entry at or before ``x`` and its first one after.

    An entry is a struct of ``x`` and ``values``.  Rows of both sides share one exchange and are sorted once in each
    direction, so nothing is multiplied and no row carries an axis; both are null where the call has no entry there.
    """
    entry = F.struct(axis_x.cast("double").alias("x"), *values)
    right = axis.select("call_id", F.lit(0).alias("_q"), axis_x.cast("double").alias("_x"), entry.alias("_e"))
    left = df.withColumns({"_q": F.lit(1), "_x": x.cast("double"), "_e": F.lit(None).cast(right.schema["_e"].dataType)})
    both = left.unionByName(right, allowMissingColumns=True)
    up = W.partitionBy("call_id").orderBy("_x", "_q", "_e").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("call_id").orderBy(F.desc("_x"), F.desc("_q"), F.desc("_e")).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_b", F.last("_e", ignorenulls=True).over(up)).withColumn("_a", F.last("_e", ignorenulls=True).over(down))
    return found.filter("_q = 1").select(*df.columns, "_b", "_a")


def _closer(x: Column) -> Column:
    """The nearer of the entries ``_b`` and ``_a``, the earlier one on ties."""
    after = F.col("_b").isNull() | (F.col("_a.x") - x < x - F.col("_b.x"))
    return F.when(F.coalesce(after, F.lit(False)), F.col("_a")).otherwise(F.col("_b"))


def nearest_by_call(df: DataFrame, axis: DataFrame, col: str, value: str, out: str = "nearest") -> DataFrame:
    """Nearest value of a per-call axis table (call_id, value), the lower one on ties; null without an axis."""
    found = bracket(df, axis.filter(F.col(value).isNotNull()), F.col(col), F.col(value))
    return found.withColumn(out, _closer(F.col(col))["x"]).select(*df.columns, out)


def nearest_frame(df: DataFrame, grid: DataFrame, out: str) -> DataFrame:
    """Rows with the frame of the call's grid that is nearest in time; rows of calls without a grid are left out."""
    found = bracket(df, grid, F.col("time"), F.col("time"), F.col("frame_idx"))
    return found.withColumn(out, _closer(F.col("time"))["frame_idx"]).filter(F.col(out).isNotNull()).select(*df.columns, out)


def interpolated(df: DataFrame, src: DataFrame, left: float | None, right: float | None, out: str) -> DataFrame:
    """Rows with the call's (time, frequency) table interpolated at their time, and ``_any``: the call has such a table.

    Outside: the given values, else the end values.
    """
    found = bracket(df, src, F.col("time"), F.col("time"), F.col("frequency").alias("f"))
    x, x0, x1, f0, f1 = F.col("time"), F.col("_b.x"), F.col("_a.x"), F.col("_b.f"), F.col("_a.f")
    inside = F.when((x1 > x0) & (x > x0), f0 + (f1 - f0) * ((x - x0) / F.when(x1 > x0, x1 - x0))).otherwise(f0)
    before = f1 if left is None else F.lit(float(left))
    after = f0 if right is None else F.when(x > x0, F.lit(float(right))).otherwise(f0)
    value = F.when(F.col("_b").isNull(), before).when(F.col("_a").isNull(), after).otherwise(inside)
    some = F.col("_b").isNotNull() | F.col("_a").isNotNull()
    return found.select(*df.columns, F.when(some, value).alias(out), some.alias("_any"))


def amplitude_at(
    contour: DataFrame,
    tf_frame: DataFrame,
    axis: Sequence[float],
    mult: float = 1.0,
    fill: float = 0.0,
    include_indices: bool = False,
    limit_frequency: bool = True,
) -> DataFrame:
    """Grid magnitude at the nearest frame and channel of every contour point.

    The frame is found by a merge of both time axes; the dense frames are then joined on (call, frame), so each
    contour point meets exactly one frame row.
    """
    hz = F.col("frequency") * mult
    t = F.col("time")
    ok = X.finite(t) & X.finite(hz) & (hz > 0)
    ok = ok & F.col("_b").isNotNull() & (F.col("_a").isNotNull() | (F.col("_b.x") == t))
    if limit_frequency:
        ok = ok & (hz >= float(min(axis))) & (hz <= float(max(axis)))
    ok = F.coalesce(ok, F.lit(False))
    located = (
        bracket(contour, tf_frame, t, F.col("time"), F.col("frame_idx"))
        .withColumn("_ok", ok)
        .withColumn("_frame", F.when(F.col("_ok"), _closer(t)["frame_idx"]))
        .withColumn("_channel", F.when(F.col("_ok"), nearest_index(A.dlit(sorted(axis)), hz)))
        .drop("_a", "_b")
    )
    grid = tf_frame.select("call_id", F.col("frame_idx").alias("_frame"), F.col("time").alias("_t"), F.col("mags").alias("_m"))
    joined = located.join(grid, ["call_id", "_frame"], "left")
    amp = F.coalesce(F.get("_m", F.col("_channel")), F.lit(float(fill)))
    extra = []
    if include_indices:
        extra = [
            F.coalesce("_frame", F.lit(-1)).alias("amplitude_frame"),
            F.coalesce("_channel", F.lit(-1)).alias("amplitude_channel"),
            F.coalesce(F.when(F.col("_ok"), F.col("_t")), F.lit(float(fill))).alias("amplitude_time"),
            F.coalesce(F.get(A.dlit(sorted(axis)), F.col("_channel")), F.lit(float(fill))).alias("amplitude_frequency"),
        ]
    return joined.select(*contour.columns, amp.alias("amplitude"), F.col("_ok").alias("in_grid"), *extra)


def magnitude_at(contour: DataFrame, tf_frame: DataFrame, axis: Sequence[float]) -> DataFrame:
    """Same on a spectrum grid: only a positive frequency and a time inside the grid are required."""
    out = amplitude_at(contour, tf_frame, axis, limit_frequency=False)
    return out.withColumnRenamed("amplitude", "magnitude").drop("in_grid")


def coverage_points(sampled: DataFrame) -> DataFrame:
    """In-grid and total points per call."""
    return sampled.groupBy("call_id").agg(
        F.count_if("in_grid").alias("valid_points"), F.count(F.lit(1)).alias("total_points")
    )


def sample_rows(tf_frame: DataFrame, axis: Sequence[float], targets: Sequence[float]) -> DataFrame:
    """Frames linearly sampled at fixed frequencies; (call_id, frame_idx, target, value, valid)."""
    m, valid = A.interp_matrix(axis, targets)
    sampled = A.linear_map_frame(F.col("mags"), m)
    return (
        tf_frame.select("call_id", "frame_idx", F.posexplode(sampled).alias("target", "value"))
        .withColumn("valid", F.get(A.constant([bool(v) for v in valid], "array<boolean>"), F.col("target")))
    )


def sample_at(frame: Column, axis: Column, hz: Column) -> Column:
    """Linear sample of one frame at one frequency; the first and last segments extend outward."""
    n = F.size(axis)
    right = F.greatest(F.least(F.size(F.filter(axis, lambda v: v < hz)), n - 1), F.lit(1))

    def body(r: Column) -> Column:
        x0, x1 = F.get(axis, r - 1), F.get(axis, r)
        a = F.when(x1 > x0, (hz - x0) / F.when(x1 > x0, x1 - x0)).otherwise(0.0)
        return (1.0 - a) * F.get(frame, r - 1) + a * F.get(frame, r)

    return A.let(right, body)


def sample_path(frames: Column, axis: Column, path: Column) -> Column:
    """Sample a lattice (frames of states) along a time-varying path."""
    return F.zip_with(frames, path, lambda fr, hz: sample_at(fr, axis, hz))


def band_mean_at(frame: Column, centre: Column, radius: int) -> Column:
    """Mean of channels within ``radius`` of a channel, limited to the axis."""
    lo = F.greatest(centre - radius, F.lit(0))
    hi = F.least(centre + radius, F.size(frame) - 1)
    return A.array_sum(F.slice(frame, lo + 1, hi - lo + 1)) / (hi - lo + 1)


def band_mean(points: DataFrame, tf_frame: DataFrame, radius: int, bin_col: str = "bin") -> DataFrame:
    """Band mean around a bin of the frame at (call_id, frame_idx)."""
    grid = tf_frame.select("call_id", "frame_idx", "mags")
    return points.join(grid, ["call_id", "frame_idx"]).withColumn(
        "band_mean", band_mean_at(F.col("mags"), F.col(bin_col), radius)
    ).drop("mags")


def neighbours(df: DataFrame, radius: int, n: int, base: str = "base", top_open: bool = True) -> DataFrame:
    """Candidate bins base +- radius, interior only (the last bin excluded when ``top_open``)."""
    last = n - 2 if top_open else n - 1
    return df.withColumn("bin", F.explode(F.sequence(F.col(base) - radius, F.col(base) + radius))).filter(
        (F.col("bin") >= 1) & (F.col("bin") <= last)
    )


def matrix_table(spark: SparkSession, m: np.ndarray) -> DataFrame:
    """Nonzero cells of a constant matrix as (outer, inner, weight)."""
    rows = [(int(r), int(c), float(m[r, c])) for r, c in zip(*np.nonzero(np.asarray(m)))]
    return spark.createDataFrame(rows, "outer int, inner int, weight double")


def apply_matrix(tf: DataFrame, matrix: DataFrame) -> DataFrame:
    """Long-form matrix application: broadcast the configuration-sized matrix, sum by outer index.

    For dense frames ``frames.map_frames`` does the same without the shuffle.
    """
    return (
        tf.join(F.broadcast(matrix), tf["channel"] == matrix["inner"])
        .groupBy("call_id", "frame_idx", F.col("outer").alias("channel"))
        .agg(F.sum(F.col("magnitude") * F.col("weight")).alias("magnitude"))
    )


def regrid(contour: DataFrame, grid: DataFrame, left: float | None = None, right: float | None = None) -> DataFrame:
    """Contour frequencies on another time grid (call_id, frame_idx, time) by linear interpolation.

    Calls without a contour are left out; a grid equal to the contour's copies it.
    """
    found = interpolated(grid.select("call_id", "frame_idx", "time"), contour, left, right, "frequency")
    return found.filter("_any").drop("_any")


def resize(values: Column, m: Column) -> Column:
    """Resample an array to ``m`` points on half-pixel centres with held ends; equal sizes copy."""

    def body(v: Column) -> Column:
        n = F.size(v)

        def at(i: Column) -> Column:
            x = F.greatest((i + 0.5) * n / m - 0.5, F.lit(0.0))
            lo = F.least(F.floor(x).cast("int"), n - 1)
            hi = F.least(lo + 1, n - 1)
            return F.get(v, lo) + (F.get(v, hi) - F.get(v, lo)) * (x - lo)

        return F.when(n == m, v).otherwise(F.transform(A.seq(m), at))

    return A.let(values, body)


def with_params(df: DataFrame, grid: Sequence[Mapping[str, float]]) -> DataFrame:
    """Every row once per configuration of a parameter grid (an exploded constant, not a join)."""
    if not grid:
        raise ValueError("the parameter grid is empty")
    items = [
        F.struct(F.lit(i).alias("config_id"), *[F.lit(v).alias(k) for k, v in cfg.items()]) for i, cfg in enumerate(grid)
    ]
    return df.withColumn("_p", F.explode(F.array(*items))).select(*df.columns, "_p.*")


def blank_contour(wf: DataFrame, dt: float) -> DataFrame:
    """Zeros at frame resolution over the call, at least one frame, confidence 1."""
    seconds = F.size("samples") / F.col("sr")
    n = F.greatest(F.ceil(F.greatest(seconds, F.lit(dt * 0.5)) / dt - 1e-9).cast("int"), F.lit(1))
    return wf.select("call_id", F.explode(A.seq(n)).alias("frame_idx")).select(
        "call_id",
        "frame_idx",
        (F.col("frame_idx") * dt).alias("time"),
        F.lit(0.0).alias("frequency"),
        F.lit(1.0).alias("confidence"),
    )


def effective_contour(extracted: DataFrame, corrected: DataFrame, wf: DataFrame, dt: float) -> DataFrame:
    """Time base: extracted, else corrected, else a blank grid; frequencies: corrected wherever present.

    A corrected contour on another grid is interpolated onto the time base, 0 outside its span.
    """
    have = lambda d: d.select("call_id").distinct()
    cols = ["call_id", "frame_idx", "time", "frequency"]
    base = extracted.select(*cols, F.lit("extracted").alias("source"))
    only_corrected = corrected.join(have(extracted), "call_id", "left_anti").select(*cols, F.lit("corrected").alias("source"))
    neither = wf.join(have(extracted), "call_id", "left_anti").join(have(corrected), "call_id", "left_anti")
    blank = blank_contour(neither, dt).select(*cols, F.lit("blank").alias("source"))
    grid = base.unionByName(only_corrected).unionByName(blank)
    edited = interpolated(grid, corrected, 0.0, 0.0, "_edited")
    return edited.select(
        "call_id",
        "frame_idx",
        "time",
        F.when(F.col("_any"), F.col("_edited")).otherwise(F.col("frequency")).alias("frequency"),
        F.when(F.col("_any"), F.lit("corrected")).otherwise(F.col("source")).alias("source"),
    )
