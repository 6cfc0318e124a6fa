"""Scalar column expressions and per-call projections on contours and grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import arrays as A
from .ranks import positive_medians


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def h1_to_f0(c: Column | str) -> Column:
    """The visible ridge is the second harmonic."""
    return _c(c) / 2.0


def f0_to_h1(c: Column | str) -> Column:
    return _c(c) * 2.0


def to_db(tf: DataFrame, floor: float = 1e-5, top_db: float = 80.0) -> DataFrame:
    """Add ``db``: decibels against the call maximum, floored ``top_db`` below it.

    The maximum is combined per task before the shuffle; the grid is not sorted, and one row per call is joined.
    """
    peaks = tf.groupBy("call_id").agg(F.greatest(F.max("magnitude"), F.lit(floor)).alias("_peak"))
    db = 20.0 * F.log10(F.greatest("magnitude", F.lit(floor))) - 20.0 * F.log10("_peak")
    return tf.join(peaks, "call_id").withColumn("db", F.greatest(db, F.lit(-top_db))).select(*tf.columns, "db")


def log_mag(tf: DataFrame, mode: str = "eps") -> DataFrame:
    """Add ``log_mag``: ``ln(x + 1e-10)``, or ``ln(max(x, 1e-6 * median positive of the call))``.

    A call without a positive value has the floor 1e-12.
    """
    m = F.col("magnitude")
    if mode == "eps":
        return tf.withColumn("log_mag", F.log(m + 1e-10))
    if mode != "floored":
        raise ValueError("mode must be 'eps' or 'floored'")
    median = positive_medians(tf, "magnitude").withColumnRenamed("median", "_median")
    out = tf.join(median, "call_id", "left").withColumn("log_mag", F.log(F.greatest(m, F.coalesce(F.col("_median") * 1e-6, F.lit(1e-12)))))
    return out.select(*tf.columns, "log_mag")


def power(tf: DataFrame, p: float = 2.0) -> DataFrame:
    return tf.withColumn("power", F.pow(F.abs("magnitude"), F.lit(float(p))))


def band(tf: DataFrame, lo: float, hi: float) -> DataFrame:
    """Inclusive frequency band; a plain predicate, so it reaches the scan of a stored grid."""
    if lo > hi:
        raise ValueError(f"empty frequency band {lo}-{hi} Hz")
    return tf.filter((F.col("freq_hz") >= lo) & (F.col("freq_hz") <= hi))


def band_channels(axis: list[float], lo: float, hi: float) -> tuple[int, int]:
    """First channel and number of channels inside a band of an ascending axis."""
    inside = [i for i, f in enumerate(axis) if lo <= f <= hi]
    if not inside:
        raise ValueError(f"no frequency bins in range {lo}-{hi} Hz")
    return inside[0], len(inside)


def finite(c: Column | str) -> Column:
    c = _c(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def voiced(c: Column | str, min_f0: float = 0.0) -> Column:
    """True for a finite value above ``min_f0``."""
    return finite(c) & (_c(c) > min_f0)


def harmonics(contour: DataFrame, k_max: int, nyquist: float, col: str = "f0") -> DataFrame:
    """One row per valid harmonic ``k * F0`` in (0, nyquist]."""
    exploded = contour.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(k_max))))
    hz = F.col("k") * F.col(col)
    return exploded.withColumn("harmonic_hz", hz).filter((hz > 0) & (hz <= nyquist))


def harm_weight(k: Column | str, p: float) -> Column:
    return F.pow(_c(k).cast("double"), F.lit(-float(p)))


def quad_offset(left: Column, centre: Column, right: Column, limit: float = 1.0) -> Column:
    """Sub-bin offset of a parabola through three points; 0 when flat."""
    denom = left - centre * 2.0 + right
    ok = finite(denom) & (F.abs(denom) > 1e-12)
    return F.when(ok, A.clip((left - right) * 0.5 / F.when(ok, denom), -limit, limit)).otherwise(F.lit(0.0))


def sigmoid_margin(a: Column, b: Column) -> Column:
    """Logistic confidence of ``a - b`` with the margin limited to +-12."""
    return 1.0 / (1.0 + F.exp(-A.clip(a - b, -12.0, 12.0)))


def zscore(df: DataFrame, col: str, out: str = "z") -> DataFrame:
    """Population z-score within the call; 0 without spread."""
    w = W.partitionBy("call_id")
    sd = F.stddev_pop(col).over(w)
    return df.withColumn(out, F.when(sd > 0, (F.col(col) - F.avg(col).over(w)) / F.when(sd > 0, sd)).otherwise(0.0))


def highpass_gain(freq: Column | str, cutoff: float, sr: float, order: int = 5) -> Column:
    """Forward-and-backward Butterworth gain at a frequency; cutoff <= 0 switches it off."""
    if cutoff <= 0:
        return F.lit(1.0)
    f = _c(freq)
    fc = min(cutoff, 0.99 * sr / 2.0)
    ratio = math.tan(math.pi * fc / sr) / F.tan(f * (math.pi / sr))
    return F.when(f <= 0, F.lit(0.0)).when(f >= sr / 2.0, F.lit(1.0)).otherwise(
        1.0 / (1.0 + F.pow(ratio, F.lit(2.0 * order)))
    )


def frame_time(frame: Column | str, hop: float, sr: float) -> Column:
    return _c(frame) * hop / sr


def time_frame(time: Column | str, hop: float, sr: float, n_frames: Column | int) -> Column:
    """Nearest frame (half to even), limited to the grid."""
    last = (F.lit(n_frames) if isinstance(n_frames, int) else n_frames) - 1
    return F.greatest(F.least(F.rint(_c(time) * sr / hop).cast("int"), last), F.lit(0))


def blue_mask(r: Column | str, g: Column | str, b: Column | str) -> Column:
    """Pixels of a blue drawing frame, given 0-255 channels."""
    r, g, b = _c(r), _c(g), _c(b)
    chroma = F.greatest(r, g, b) - F.least(r, g, b)
    return (b >= 70) & (b - r >= 20) & (b - g >= 7) & (chroma >= 20)


def ink_mask(r: Column | str, g: Column | str, b: Column | str, threshold: float = 135.0) -> Column:
    """Neutral dark pixels; bright bluish ones are printed grid, not ink."""
    r, g, b = _c(r), _c(g), _c(b)
    luminance = r * 0.2126 + g * 0.7152 + b * 0.0722
    printed = (b - r > 10) & (b - g > 2) & (luminance >= 82)
    return (luminance < threshold) & ~printed
