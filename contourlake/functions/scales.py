"""Auditory frequency scales, axes, bandwidths, windows (column expressions over any numeric column)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCALES = ("erb", "mel", "log10", "elelog")

# Fixed values of the scales.
ERB_FACTOR = 9.2645
ERB_RATE = 0.00437
MEL_CORNER = 700.0
MEL_LOG = math.log(17 / 7)
ELE_FMIN = 5.0
ELE_FMAX = 1000.0
ELE_K = 0.88
ELE_A = ELE_FMIN / (1 - ELE_K)
ELE_ALPHA = math.log10(ELE_FMAX / ELE_A + ELE_K)


def _col(c: Column | str | float) -> Column:
    return c if isinstance(c, Column) else (F.col(c) if isinstance(c, str) else F.lit(float(c)))


def _unknown(scale: str) -> ValueError:
    return ValueError(f"no frequency scale named {scale!r}; known are {sorted(SCALES)}")


def hz_to_aud(c: Column | str | float, scale: str = "erb") -> Column:
    """Hz to auditory units."""
    f = _col(c)
    scale = scale.lower()
    if scale == "erb":
        return F.signum(f) * F.log1p(F.abs(f) * ERB_RATE) * ERB_FACTOR
    if scale == "mel":
        return F.signum(f) * F.log1p(F.abs(f) / MEL_CORNER) * (1000.0 / MEL_LOG)
    if scale == "log10":
        return F.log10(F.greatest(f, F.lit(1.0)))
    if scale == "elelog":
        return F.log10(f / ELE_A + ELE_K) / ELE_ALPHA
    raise _unknown(scale)


def aud_to_hz(c: Column | str | float, scale: str = "erb") -> Column:
    """Auditory units back to Hz."""
    a = _col(c)
    scale = scale.lower()
    if scale == "erb":
        return F.expm1(a / ERB_FACTOR) / ERB_RATE
    if scale == "mel":
        return F.signum(a) * F.expm1(F.abs(a) * (MEL_LOG / 1000.0)) * MEL_CORNER
    if scale == "log10":
        return F.pow(F.lit(10.0), a)
    if scale == "elelog":
        return (F.pow(F.lit(10.0), a * ELE_ALPHA) - ELE_K) * ELE_A
    raise _unknown(scale)


def _warp(lo: float, hi: float, scale: str) -> tuple[Column, Column, Column, Column]:
    """Constant end points and tail slopes of the warped scale (folded by the optimizer)."""
    if lo <= 0:
        raise ValueError("the lower transition frequency must be positive")
    a_lo, a_hi = hz_to_aud(lo, scale), hz_to_aud(hi, scale)
    s_lo = (hz_to_aud(lo * 1.01, scale) - a_lo) / (lo * 0.01)
    s_hi = (hz_to_aud(hi * 1.01, scale) - a_hi) / (hi * 0.01)
    return a_lo, a_hi, s_lo, s_hi


def hz_to_aud_mod(c: Column | str, lo: float, hi: float, scale: str = "erb") -> Column:
    """Auditory units inside [lo, hi], linear tails outside."""
    f = _col(c)
    a_lo, a_hi, s_lo, s_hi = _warp(lo, hi, scale)
    return (
        F.when(f < lo, s_lo * (f - lo) + a_lo)
        .when(f > hi, s_hi * (f - hi) + a_hi)
        .otherwise(hz_to_aud(f, scale))
    )


def aud_to_hz_mod(c: Column | str, lo: float, hi: float, scale: str = "erb") -> Column:
    a = _col(c)
    a_lo, a_hi, s_lo, s_hi = _warp(lo, hi, scale)
    return (
        F.when(a < a_lo, (a - a_lo) / s_lo + lo)
        .when(a > a_hi, (a - a_hi) / s_hi + hi)
        .otherwise(aud_to_hz(a, scale))
    )


def aud_axis(spark: SparkSession, lo: float, hi: float, n: int, scale: str = "erb", fs: int = 16000) -> DataFrame:
    """``n`` channels equally spaced on the scale: (channel, freq_hz, aud); end points exact."""
    if n <= 0:
        raise ValueError("the number of channels must be positive")
    if lo > hi:
        raise ValueError("lo must not exceed hi")
    rows = spark.range(n).select(F.col("id").cast("int").alias("channel"))
    frac = F.col("channel") / float(max(n - 1, 1))
    if lo == hi:
        nyq = float(fs // 2)
        return rows.withColumn("freq_hz", frac * nyq).withColumn("aud", hz_to_aud_mod("freq_hz", nyq, nyq, scale))
    a_lo, a_hi = hz_to_aud(lo, scale), hz_to_aud(hi, scale)
    rows = rows.withColumn("aud", a_lo + (a_hi - a_lo) * frac)
    inner = aud_to_hz_mod("aud", lo, hi, scale)
    freq = F.when(F.col("channel") == n - 1, F.lit(float(hi))).when(F.col("channel") == 0, F.lit(float(lo))).otherwise(inner)
    return rows.select("channel", freq.alias("freq_hz"), "aud")


def axis_values(lo: float, hi: float, n: int, scale: str = "elelog") -> list[float]:
    """The same axis as plain numbers, for configuration-sized constants."""
    fwd = {
        "erb": lambda f: ERB_FACTOR * math.log1p(f * ERB_RATE),
        "mel": lambda f: 1000.0 / MEL_LOG * math.log1p(f / MEL_CORNER),
        "log10": lambda f: math.log10(max(f, 1.0)),
        "elelog": lambda f: math.log10(f / ELE_A + ELE_K) / ELE_ALPHA,
    }
    inv = {
        "erb": lambda a: math.expm1(a / ERB_FACTOR) / ERB_RATE,
        "mel": lambda a: MEL_CORNER * math.expm1(a * MEL_LOG / 1000.0),
        "log10": lambda a: 10.0**a,
        "elelog": lambda a: ELE_A * (10.0 ** (a * ELE_ALPHA) - ELE_K),
    }
    if scale not in fwd:
        raise _unknown(scale)
    a0, a1 = fwd[scale](lo), fwd[scale](hi)
    out = [inv[scale](a0 + (a1 - a0) * i / max(n - 1, 1)) for i in range(n)]
    out[0], out[-1] = float(lo), float(hi)
    return out


def _guard(c: Column, what: str) -> Column:
    return F.when(c < 0, F.raise_error(F.lit(f"{what} is below zero")).cast("double")).otherwise(c)


def fc_to_bw(c: Column | str, scale: str = "mel") -> Column:
    """Critical bandwidth at a centre frequency; negative input is an error."""
    f = _guard(_col(c), "centre frequency")
    if scale == "erb":
        return f / 9.265 + 24.7
    if scale == "mel":
        return (f + MEL_CORNER) * (math.log10(17 / 7) / 1000.0)
    if scale == "log10":
        return f
    raise _unknown(scale)


def bw_to_fc(c: Column | str, scale: str = "mel") -> Column:
    """Centre frequency with a given critical bandwidth."""
    b = _guard(_col(c), "bandwidth")
    if scale == "erb":
        return (b - 24.7) * 9.265
    if scale == "mel":
        return b * (1000.0 / math.log10(17 / 7)) - MEL_CORNER
    if scale == "log10":
        return b
    raise _unknown(scale)


def hann(spark: SparkSession, n: int, periodic: bool = False, padto: int | None = None) -> DataFrame:
    """Window table (n, w): periodic, or symmetric normalised to unit sum and centred in a pad."""
    rows = spark.range(n).select(F.col("id").cast("int").alias("n"))
    if periodic:
        return rows.withColumn("w", 0.5 - 0.5 * F.cos(F.col("n") * (2.0 * math.pi / n)))
    padto = n if padto is None else padto
    if padto < n:
        raise ValueError("padto must not be shorter than the window")
    total = 0.5 * (n - 1) if n > 1 else 1.0
    start = (padto - n) // 2
    k = F.col("n") - start
    inside = (0.5 - 0.5 * F.cos(k * (2.0 * math.pi / (n - 1)))) / total if n > 1 else F.lit(1.0)
    return (
        spark.range(padto)
        .select(F.col("id").cast("int").alias("n"))
        .withColumn("w", F.when((k >= 0) & (k < n), inside).otherwise(F.lit(0.0)))
    )


def modulate(win: DataFrame, fc: float, fs: float) -> DataFrame:
    """Shift a window table to a centre frequency: adds (re, im)."""
    phase = F.col("n") * (2.0 * math.pi * fc / fs)
    return win.withColumn("re", F.col("w") * F.cos(phase)).withColumn("im", F.col("w") * F.sin(phase))


def dual_window(win: DataFrame, hop: int, eps: float = 1e-8) -> DataFrame:
    """Canonical dual: divide by the sum of squares within each hop residue class."""
    same = W.partitionBy(F.col("n") % hop)
    return win.withColumn("dual", F.col("w") / F.greatest(F.sum(F.col("w") * F.col("w")).over(same), F.lit(eps)))
