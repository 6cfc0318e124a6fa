"""Smoothing and running operators on contour rows and spectra."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import series as R


def _on_calls(contour: DataFrame, cols: list[str], out: dict) -> DataFrame:
    """Pack the named columns per call, compute new arrays, return rows with the new columns."""
    packed = R.pack(contour, cols)
    for name, fn in out.items():
        packed = packed.withColumn(name, fn(*[F.col(c) for c in cols]))
    return R.unpack(packed, list(dict.fromkeys(["frame_idx", *cols, *out])))


def median_filter(contour: DataFrame, k: int, col: str = "frequency", out: str = "smoothed") -> DataFrame:
    """Mirror-edge median along time applied to values above 0."""
    return _on_calls(contour, [col], {out: lambda a: R.median_positive(a, k)})


def gated_median(contour: DataFrame, k: int, threshold: float | None = None, out: str = "smoothed") -> DataFrame:
    """Confidence-gated median over the compacted sequence."""
    thr = None if threshold is None else F.lit(float(threshold))
    return _on_calls(contour, ["frequency", "confidence"], {out: lambda f, c: R.gated_median(f, c, k, thr)})


def voiced_run_median(contour: DataFrame, k: int, col: str = "frequency", out: str = "smoothed") -> DataFrame:
    return _on_calls(contour, [col], {out: lambda a: R.voiced_run_median(a, k)})


def modulation(contour: DataFrame, col: str = "frequency") -> DataFrame:
    """First difference with the first value prepended, and the difference of that."""
    w = W.partitionBy("call_id").orderBy("frame_idx")
    step = contour.withColumn("modulation", F.col(col) - F.coalesce(F.lag(col).over(w), F.col(col)))
    return step.withColumn(
        "curvature", F.col("modulation") - F.coalesce(F.lag("modulation").over(w), F.col("modulation"))
    )


def gauss_smooth(tf_frame: DataFrame, sigma: float) -> DataFrame:
    """Gaussian along the channel axis, nearest edges; frames must share one channel count."""
    return _kernel_smooth(tf_frame, A.gaussian_weights(max(float(sigma), 0.5)))


def box_smooth(tf_frame: DataFrame, radius: int) -> DataFrame:
    """Mean of ``2 * radius + 1`` channels, nearest edges."""
    return _kernel_smooth(tf_frame, np.full(2 * radius + 1, 1.0 / (2 * radius + 1)))


def _kernel_smooth(tf_frame: DataFrame, weights: np.ndarray) -> DataFrame:
    r = len(weights) // 2
    w = A.dlit(weights)

    def run(v: Column) -> Column:
        last = F.size(v) - 1
        return F.transform(
            v,
            lambda _, i: A.array_sum(
                F.transform(w, lambda g, j: g * F.get(v, F.greatest(F.least(i + j - r, last), F.lit(0))))
            ),
        )

    return tf_frame.withColumn("mags", A.let(F.col("mags"), run))


def energy_gate(contour: DataFrame, threshold: float = 0.2, peak: str = "peak") -> DataFrame:
    """Zero frequency and confidence where the frame peak is below a share of the call's strongest."""
    top = F.max(peak).over(W.partitionBy("call_id"))
    weak = (top > 0) & (F.col(peak) < top * threshold)
    zero = F.lit(0.0)
    return contour.withColumn("_weak", weak).select(
        *[
            F.when(F.col("_weak"), zero).otherwise(F.col(c)).alias(c) if c in ("frequency", "confidence") else F.col(c)
            for c in contour.columns
        ]
    )


def cum_energy(psd: DataFrame, key: str = "call_id") -> DataFrame:
    """Cumulative normalised energy along frequency, per spectrum."""
    w = W.partitionBy(key).orderBy("freq_hz")
    return psd.withColumn(
        "cum", F.sum("psd").over(w.rowsBetween(W.unboundedPreceding, 0)) / F.sum("psd").over(W.partitionBy(key))
    )


def edge_radius(contour: DataFrame, kernel: int, stride: int, radius: int) -> DataFrame:
    """Search radius per frame: 1 near both ends (half a kernel), ``radius`` elsewhere."""
    edge = kernel // 2 // max(stride, 1)
    n = F.count(F.lit(1)).over(W.partitionBy("call_id"))
    near = F.lit(edge > 0) & ((F.col("frame_idx") < edge) | (F.col("frame_idx") >= n - edge))
    return contour.withColumn("radius", F.when(near, F.lit(1)).otherwise(F.lit(max(0, radius))))


def marker_bounds(contour: DataFrame) -> DataFrame:
    """First and last marked frame per call: (first_start, last_start, first_end, last_end)."""
    at = lambda flag: F.when(F.col(flag) == 1, F.col("frame_idx"))
    return contour.groupBy("call_id").agg(
        F.min(at("start_point")).alias("first_start"),
        F.max(at("start_point")).alias("last_start"),
        F.min(at("end_point")).alias("first_end"),
        F.max(at("end_point")).alias("last_end"),
    )


def roughness(contour: DataFrame, col: str = "frequency") -> DataFrame:
    """Median absolute frame-to-frame change per call."""
    return R.pack(contour, [col]).select("call_id", R.roughness(F.col(col)).alias("roughness"))
