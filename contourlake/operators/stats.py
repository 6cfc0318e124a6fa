"""Corpus statistics, contour evaluation and run summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..functions.ranks import exact_percentiles, value_ranks

WINDOW_SIZES = (1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 6.0)
PERCENTILES = (10, 25, 50, 75, 90, 95, 99)


def anchor(tf: DataFrame) -> DataFrame:
    """Global peak channel (largest time mean) and strongest frame (largest sum); the first wins ties."""
    ch = tf.groupBy("call_id", "channel").agg(F.avg("magnitude").alias("v"))
    fr = tf.groupBy("call_id", "frame_idx").agg(F.sum("magnitude").alias("v"))
    top = lambda d, c, out: d.groupBy("call_id").agg(F.max_by(c, F.struct("v", -F.col(c))).alias(out))
    return top(ch, "channel", "peak_channel").join(top(fr, "frame_idx", "start_frame"), "call_id")


def peak_share(tf: DataFrame) -> DataFrame:
    """Share of the frame's magnitude held by its peak; 0 for a silent frame."""
    total = F.sum("magnitude")
    return tf.groupBy("call_id", "frame_idx").agg(
        F.max("magnitude").alias("peak"),
        F.when(total > 0, F.max("magnitude") / F.when(total > 0, total)).otherwise(0.0).alias("share"),
    )


def duration_stats(calls: DataFrame, col: str = "duration") -> DataFrame:
    """Count, range, mean, median, population deviation and percentiles as one row."""
    basic = calls.agg(
        F.count(col).alias("n"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
        F.avg(col).alias("mean"),
        F.stddev_pop(col).alias("std"),
    )
    pct = exact_percentiles(calls, col, PERCENTILES).withColumn("median", F.col("p50"))
    return basic.join(F.broadcast(pct))


def window_coverage(calls: DataFrame, sizes: Sequence[float] = WINDOW_SIZES, col: str = "duration") -> DataFrame:
    """Usable calls per window size, with the recommended size flagged.

    Recommended: the largest size usable by at least 90 %, else the largest usable by at least 80 %.
    """
    one = calls.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(col) >= s).alias(f"u{i}") for i, s in enumerate(sizes)]
    )
    items = [F.struct(F.lit(float(s)).alias("size"), F.col(f"u{i}").alias("usable")) for i, s in enumerate(sizes)]
    pct = lambda u: u * 100.0 / F.greatest(F.col("total"), F.lit(1))
    best = lambda floor: F.array_max(
        F.transform(F.filter(F.col("items"), lambda z: pct(z["usable"]) >= floor), lambda z: z["size"])
    )
    rec = one.withColumn("items", F.array(*items)).withColumn("recommended", F.coalesce(best(90.0), best(80.0)))
    return rec.select("total", "recommended", F.explode("items").alias("z")).select(
        F.col("z.size").alias("size"),
        F.col("z.usable").alias("usable"),
        pct(F.col("z.usable")).alias("percent"),
        F.coalesce(F.col("z.size") == F.col("recommended"), F.lit(False)).alias("recommended"),
    )


def length_flags(calls: DataFrame, setting: float = 4.0, short: float = 2.0, long: float = 10.0, col: str = "duration") -> DataFrame:
    """Counts and shares of short, long and excluded calls."""
    d = F.col(col)
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    kinds = {"short": d < short, "long": d > long, "excluded": d < setting}
    return calls.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(c).alias(f"{k}_calls") for k, c in kinds.items()],
        *[(F.count_if(c) / n).alias(f"{k}_share") for k, c in kinds.items()],
    )


def duration_ecdf(calls: DataFrame, col: str = "duration") -> DataFrame:
    """Empirical distribution: share of calls no longer than each distinct duration."""
    total = calls.agg(F.count(col).alias("total"))
    return (
        value_ranks(calls, col)
        .join(F.broadcast(total))
        .select(F.col("value").alias(col), "n", (F.col("cum") / F.col("total")).alias("ecdf"))
    )


# ---------------------------------------------------------------- spectra


def welch_psd(wf: DataFrame, sr: float, nperseg: int = 4096) -> DataFrame:
    """Power density per call (call_id, psd array): Hann segments, half overlap, mean removed, one-sided.

    A call shorter than ``nperseg`` is one shorter segment whose transform is filled with zeros to ``nperseg``, so all
    calls have the same bins; a call without samples has no density (null).
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(samples: pd.Series) -> pd.Series:
        return samples.map(lambda x: _welch(np.asarray(x, dtype=float), sr, nperseg))

    return wf.select("call_id", run("samples").alias("psd"))


def _welch(x: np.ndarray, sr: float, nperseg: int) -> np.ndarray | None:
    n = min(nperseg, len(x))
    if n == 0:
        return None
    w = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(n) / n)
    seg = np.lib.stride_tricks.sliding_window_view(x, n)[:: n - n // 2]
    seg = seg - seg.mean(axis=1, keepdims=True)
    p = np.abs(np.fft.rfft(seg * w, n=nperseg, axis=1)) ** 2 / (sr * max(np.sum(w * w), 1e-300))
    p[:, 1 : None if nperseg % 2 else -1] *= 2.0
    return p.mean(axis=0)


def mean_psd(wf: DataFrame, sr: float, nperseg: int = 4096) -> DataFrame:
    """Average density over all calls with samples: (bin, freq_hz, psd).  Sample the calls first for an estimate."""
    return (
        welch_psd(wf, sr, nperseg).select(F.posexplode("psd").alias("bin", "p"))
        .groupBy("bin")
        .agg(F.avg("p").alias("psd"))
        .select("bin", (F.col("bin") * (float(sr) / nperseg)).alias("freq_hz"), "psd")
    )


def spectral_summary(psd: DataFrame, sr: float) -> DataFrame:
    """Peak frequency, frequency below which 90 % of the energy lies, low-frequency verdicts.

    The input is one spectrum, so its size is the number of bins.
    """
    w = W.orderBy("freq_hz")
    cum = psd.withColumn(
        "cum", F.sum("psd").over(w.rowsBetween(W.unboundedPreceding, 0)) / F.sum("psd").over(W.partitionBy())
    )
    one = cum.agg(
        F.max_by("freq_hz", F.struct("psd", -F.col("freq_hz"))).alias("peak_hz"),
        F.min(F.when(F.col("cum") >= 0.9, F.col("freq_hz"))).alias("f90_hz"),
    )
    return one.withColumn("low_energy", F.col("f90_hz") < sr / 4).withColumn("low_peak", F.col("peak_hz") < 50)


# ---------------------------------------------------------------- contours


def mean_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Mean absolute change of frequency per call over finite values; 0 when none."""
    d = F.abs(F.col("a.frequency") - F.col("b.frequency"))
    j = before.alias("b").join(after.alias("a"), ["call_id", "frame_idx"])
    return j.groupBy("call_id").agg(F.coalesce(F.avg(F.when(X.finite(d), d)), F.lit(0.0)).alias("mean_delta"))


def overall_delta(deltas: DataFrame) -> DataFrame:
    return deltas.agg(F.avg("mean_delta").alias("mean_delta"), F.count(F.lit(1)).alias("calls"))


def contour_summary(contour: DataFrame) -> DataFrame:
    """Voiced points, duration, mean and population deviation of F0 per call."""
    v = contour.filter(X.voiced("frequency")).withColumn("f0", X.h1_to_f0("frequency"))
    return v.groupBy("call_id").agg(
        F.count(F.lit(1)).alias("n_points"),
        (F.max("time") - F.min("time")).alias("duration_sec"),
        F.avg("f0").alias("mean_frequency"),
        F.stddev_pop("f0").alias("std_frequency"),
    )


def evaluate(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """Per-call agreement of two contours over frames voiced in both.

    FM correlation is the Pearson correlation of frame-to-frame differences.
    """
    j = (
        pred.select("call_id", "frame_idx", X.h1_to_f0("frequency").alias("p"))
        .join(ref.select("call_id", "frame_idx", X.h1_to_f0("frequency").alias("r")), ["call_id", "frame_idx"])
        .filter(X.voiced("p") & X.voiced("r"))
    )
    w = W.partitionBy("call_id").orderBy("frame_idx")
    next_to = F.lag("frame_idx").over(w) == F.col("frame_idx") - 1
    step = lambda c: F.when(next_to, F.col(c) - F.lag(c).over(w))
    d = j.withColumn("dp", step("p")).withColumn("dr", step("r"))
    cents = F.abs(F.log2(F.col("p") / F.col("r"))) * 1200.0
    has_corr = (F.count("dp") >= 2) & (F.stddev_pop("dp") > 0) & (F.stddev_pop("dr") > 0)
    return d.groupBy("call_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.avg(F.abs(F.col("p") - F.col("r"))).alias("mae_hz"),
        F.percentile(cents, F.lit(0.5)).alias("median_cents"),
        F.avg((cents <= 25).cast("double")).alias("within_25"),
        F.avg((cents > 200).cast("double")).alias("gross_200"),
        F.avg(F.abs(F.col("dp") - F.col("dr"))).alias("step_mae_hz"),
        F.when(has_corr, F.corr("dp", "dr")).alias("fm_corr"),
    )


def macro_average(evaluation: DataFrame) -> DataFrame:
    """Unweighted mean of every metric over calls."""
    metrics = [c for c in evaluation.columns if c not in ("call_id", "frames")]
    return evaluation.agg(F.count(F.lit(1)).alias("calls"), *[F.avg(c).alias(c) for c in metrics])


def win_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """On how many calls tracker ``a`` beats ``b``."""
    j = a.alias("a").join(b.alias("b"), "call_id")
    return j.agg(
        F.count_if(F.col("a.fm_corr") > F.col("b.fm_corr")).alias("better_fm"),
        F.count_if(F.col("a.step_mae_hz") < F.col("b.step_mae_hz")).alias("lower_step"),
        F.count_if(F.col("a.mae_hz") < F.col("b.mae_hz")).alias("lower_mae"),
        F.count(F.lit(1)).alias("calls"),
    )


def trim_stats(info: DataFrame) -> DataFrame:
    """Run statistics of trimming and stretching as one row."""
    d = F.col("end_s") - F.col("start_s")
    rate = F.when(F.col("stretched"), F.col("rate"))
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return info.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if("stretched").alias("stretched"),
        (F.count_if("stretched") * 100.0 / n).alias("stretched_percent"),
        F.avg(d).alias("mean_trim"),
        F.min(d).alias("min_trim"),
        F.max(d).alias("max_trim"),
        F.avg(rate).alias("mean_rate"),
        F.min(rate).alias("min_rate"),
        F.max(rate).alias("max_rate"),
    )


def cluster_contours(resampled: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean and population deviation per cluster and normalised position; arrays in ``contour``."""
    j = resampled.join(labels.select("call_id", "cluster"), "call_id")
    pos = j.select("cluster", F.posexplode("contour").alias("pos", "f"))
    return pos.groupBy("cluster", "pos").agg(
        F.avg("f").alias("mean"), F.stddev_pop("f").alias("std"), F.count(F.lit(1)).alias("n")
    )


