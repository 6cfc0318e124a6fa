"""Ridge tracking through a dense grid as folds over one call's frames.

A call is one row holding its frames; tracking is a left fold carrying the previous channel, so the plan is
a narrow projection after the one grouping that packed the call.  Axes are configuration: the channels
reachable from each channel are a constant table, and a step looks at that slice of the frame only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import exprs as X
from ..functions import series as R
from . import filterbank as FB
from . import frames as FR


#: Frames in a block of the fold.
BLOCK = 256


@dataclass(frozen=True)
class RidgeConfig:
    """Search band and post-processing of the plain ridge tracker."""

    f1_min: float = 22.5
    f1_max: float = 50.0
    max_jump: float | None = 1.0
    global_peak: bool = True
    energy_threshold: float = 0.2
    divide_by_2: bool = False
    median_kernel: int = 5


def _reach(axis: list[float], jump: float | None) -> tuple[list[int], list[int]]:
    """First and last channel within ``jump`` Hz of every channel of an ascending axis."""
    f = np.asarray(axis, dtype=float)
    if np.any(np.diff(f) < 0):
        raise ValueError("the frequency axis must ascend")
    if jump is None:
        return [0] * len(f), [len(f) - 1] * len(f)
    near = np.abs(f[:, None] - f[None, :]) <= jump
    return [int(np.argmax(r)) for r in near], [int(len(f) - 1 - np.argmax(r[::-1])) for r in near]


def allowed_peak(frame: Column, prev: Column, lo: Column, hi: Column) -> Column:
    """Strongest channel reachable from ``prev`` (lowest on ties); the whole frame when ``prev`` is negative."""
    start = F.when(prev < 0, F.lit(0)).otherwise(F.get(lo, prev))
    stop = F.when(prev < 0, F.size(frame) - 1).otherwise(F.get(hi, prev))
    return A.let(
        F.struct(start.alias("a"), stop.alias("b")),
        lambda r: r["a"] + A.first_max(F.slice(frame, r["a"] + 1, r["b"] - r["a"] + 1)),
    )


def _fold(frames: Column, first: Column, lo: Column, hi: Column) -> Column:
    """Channels chosen frame by frame, each within reach of the one before.

    Frames are taken in blocks, so that an array that grows frame by frame ends with its block.
    """
    none = F.expr("cast(array() as array<int>)")

    def step(s: Column, fr: Column) -> Column:
        return A.let(
            allowed_peak(fr, s["prev"], lo, hi),
            lambda c: F.struct(c.alias("prev"), F.concat(s["path"], F.array(c)).alias("path")),
        )

    def blocks(v: Column) -> Column:
        def block(s: Column, b: Column) -> Column:
            zero = F.struct(s["prev"].alias("prev"), none.alias("path"))
            inner = F.aggregate(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), zero, step)
            return A.let(inner, lambda r: F.struct(r["prev"].alias("prev"), F.concat(s["paths"], F.array(r["path"])).alias("paths")))

        zero = F.struct(first.alias("prev"), F.expr("cast(array() as array<array<int>>)").alias("paths"))
        count = F.ceil(F.size(v) / F.lit(BLOCK)).cast("int")
        return F.aggregate(A.seq(count), zero, block, lambda s: F.flatten(s["paths"]))

    return A.let(frames, blocks)


def band_frames(frames: Column, axis: list[float], lo: float, hi: float) -> tuple[Column, list[float]]:
    """Frames cut to an inclusive band, with the band's axis."""
    first, n = X.band_channels(axis, lo, hi)
    return F.transform(frames, lambda fr: F.slice(fr, first + 1, n)), list(axis[first : first + n])


def anchor(frames: Column) -> Column:
    """Struct of the global peak channel (largest time mean) and the strongest frame; first wins ties."""
    total = F.aggregate(
        F.slice(frames, 2, F.greatest(F.size(frames) - 1, F.lit(0))),
        F.get(frames, F.lit(0)),
        lambda acc, fr: F.zip_with(acc, fr, lambda a, b: a + b),
    )
    return F.struct(
        A.first_max(total).alias("channel"), A.first_max(F.transform(frames, A.array_sum)).alias("start")
    )


def track_causal(frames: Column, axis: list[float], jump: float | None) -> Column:
    """Forward fold from the first frame; the first choice is unrestricted."""
    lo, hi = (A.ilit(v) for v in _reach(axis, jump))
    return A.let(frames, lambda v: _fold(v, F.lit(-1), lo, hi))


def track_outward(frames: Column, axis: list[float], jump: float | None) -> Column:
    """Start at the strongest frame near the global peak channel, then fold forward and backward."""
    lo, hi = (A.ilit(v) for v in _reach(axis, jump))
    return outward(frames, lo, hi)


def outward(frames: Column, lo: Column, hi: Column) -> Column:
    """``track_outward`` with the reach of every channel given as columns."""

    def run(v: Column) -> Column:
        def both(a: Column) -> Column:
            return A.let(
                allowed_peak(F.get(v, a["start"]), a["channel"], lo, hi),
                lambda c: F.concat(
                    F.reverse(_fold(F.reverse(F.slice(v, 1, a["start"])), c, lo, hi)),
                    F.array(c),
                    _fold(F.slice(v, a["start"] + 2, F.size(v)), c, lo, hi),
                ),
            )

        return A.let(anchor(v), both)

    return A.let(frames, run)


def ridge_columns(frames: Column, axis: list[float], cfg: RidgeConfig) -> Column:
    """Array of structs (frequency, confidence, peak) along the tracked ridge of a call."""
    cut, f = band_frames(frames, axis, cfg.f1_min, cfg.f1_max)
    hz = A.dlit(f)

    def run(v: Column) -> Column:
        path = track_outward(v, f, cfg.max_jump) if cfg.global_peak else track_causal(v, f, cfg.max_jump)

        def measured(p: Column) -> Column:
            freq = F.transform(p, lambda c: F.get(hz, c))
            peak = F.zip_with(v, p, lambda fr, c: F.get(fr, c))
            share = F.zip_with(
                v, peak, lambda fr, m: A.let(A.array_sum(fr), lambda s: F.when(s > 0, m / F.when(s > 0, s)).otherwise(0.0))
            )
            return A.let(F.struct(freq.alias("f"), peak.alias("p"), share.alias("c")), clean)

        def clean(s: Column) -> Column:
            f1 = R.median_positive(s["f"], cfg.median_kernel)
            top = F.array_max(s["p"])
            weak = A.let(top, lambda m: F.transform(s["p"], lambda x: (m > 0) & (x < m * cfg.energy_threshold)))
            gated = lambda a, w: F.zip_with(a, w, lambda x, z: F.when(z, F.lit(0.0)).otherwise(x))
            return A.let(
                weak,
                lambda w: A.let(
                    F.struct(gated(f1, w).alias("f"), gated(s["c"], w).alias("c"), s["p"].alias("p")), finish
                ),
            )

        def finish(s: Column) -> Column:
            confident = F.exists(s["c"], lambda c: c > 0)
            out = F.when(confident, R.gated_median(s["f"], s["c"], cfg.median_kernel)).otherwise(s["f"])
            if cfg.divide_by_2:
                out = F.transform(out, lambda x: x / 2.0)
            return F.transform(
                F.arrays_zip(out.alias("frequency"), s["c"].alias("confidence"), s["p"].alias("peak")),
                lambda z: F.struct(z["frequency"], z["confidence"], z["peak"]),
            )

        return A.let(path, measured)

    return A.let(cut, run)


def track_ridge(calls: DataFrame, axis: list[float], cfg: RidgeConfig = RidgeConfig()) -> DataFrame:
    """Ridge contour of packed calls (call_id, times, frames): one row per frame."""
    ridge = F.posexplode(ridge_columns(F.col("frames"), axis, cfg)).alias("frame_idx", "z")
    return calls.select("call_id", "times", ridge).select(
        "call_id",
        "frame_idx",
        F.get("times", F.col("frame_idx")).alias("time"),
        F.col("z.frequency").alias("frequency"),
        F.col("z.confidence").alias("confidence"),
        F.col("z.peak").alias("peak"),
    )


def track_stft(
    wf: DataFrame,
    sr: float,
    n_fft: int = 8192,
    win: int | None = None,
    frame_resolution: float = 0.016,
    cfg: RidgeConfig = RidgeConfig(),
    strategy: str = "arrow",
) -> DataFrame:
    """Ridge in a short-time spectrum; only the search band leaves the transform."""
    axis, _ = FR.stft_axis(sr, n_fft, cfg.f1_min, cfg.f1_max)
    hop = int(round(sr * frame_resolution))
    grid = FR.stft(wf, sr, n_fft, hop, win, cfg.f1_min, cfg.f1_max, highpass=cfg.f1_min * 0.5, strategy=strategy)
    return track_ridge(FR.pack_calls(grid), axis, cfg)


def track_fb(wf: DataFrame, fb: FB.FilterbankConfig, cfg: RidgeConfig = RidgeConfig(), strategy: str = "arrow") -> DataFrame:
    """Ridge in the auditory filterbank."""
    grid = FB.fb_transform(wf, fb, strategy=strategy).select("call_id", "frame_idx", "time", "mags")
    return track_ridge(FR.pack_calls(grid), FB.fb_axis(fb), cfg)


def track_store(tf: DataFrame, axis: list[float], cfg: RidgeConfig = RidgeConfig()) -> DataFrame:
    """Ridge in a stored grid; the band predicate is pushed into the scan before frames are packed."""
    first, n = X.band_channels(axis, cfg.f1_min, cfg.f1_max)
    cut = X.band(tf, cfg.f1_min, cfg.f1_max)
    return track_ridge(FR.pack_calls(FR.pack_frames(cut)), axis[first : first + n], cfg)
