"""Harmonic masks on spectra: binary masks, kernel smoothing, masked spectrograms and cepstra."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..functions import series as R
from . import frames as FR
from . import lookup as L


def _f0_arrays(contour: DataFrame, counts: DataFrame, col: str) -> DataFrame:
    """One row per call: F0 on its frames (call_id, f0 array), re-gridded on half-pixel centres.  counts: call_id, n."""
    calls = R.pack(contour, [col]).join(counts, "call_id")
    return calls.select("call_id", F.transform(L.resize(F.col(col), F.col("n")), lambda v: F.greatest(v, F.lit(0.0))).alias("f0"))


def frame_f0(contour: DataFrame, frames: DataFrame, col: str = "f0") -> DataFrame:
    """Contour F0 per spectrum frame (call_id, frame_idx, f0)."""
    counts = frames.groupBy("call_id").agg((F.max("frame_idx") + 1).alias("n"))
    return _f0_arrays(contour, counts, col).select("call_id", F.posexplode("f0").alias("frame_idx", "f0"))


def mask_bins(f0: Column, sr: float, n_fft: int, n_bins: int, k_max: int, width: int) -> Column:
    """Sorted distinct bins kept for one frame: each valid harmonic's nearest bin and its neighbours."""
    k = A.ilit(list(range(1, max(1, k_max) + 1)))
    last = F.lit(n_bins - 1)

    def around(h: Column) -> Column:
        centre = F.greatest(F.least(F.rint(h * f0 / (sr / n_fft)).cast("int"), last), F.lit(0))
        off = A.ilit(list(range(-max(0, width), max(0, width) + 1)))
        return F.transform(off, lambda o: F.greatest(F.least(centre + o, last), F.lit(0)))

    valid = F.filter(k, lambda h: (h * f0 > 0) & (h * f0 <= sr * 0.5))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(valid, around))))


def harmonic_mask(
    contour: DataFrame, frames: DataFrame, sr: float, n_fft: int, k_max: int = 32, width: int = 1, col: str = "f0"
) -> DataFrame:
    """Sparse binary mask (call_id, frame_idx, bin)."""
    bins = mask_bins(F.col("f0"), sr, n_fft, n_fft // 2 + 1, k_max, width)
    return frame_f0(contour, frames, col).select("call_id", "frame_idx", F.explode(bins).alias("bin"))


@lru_cache(maxsize=32)
def kernel_values(n_fft: int, win: int, hop: int, floor: float = 1e-3) -> tuple[tuple[int, int, float], ...]:
    """Reproducing kernel of a short-time transform as (dk, dm, w); configuration-sized.

    Cell (dk, dm) is the strength with which the dual window, moved by dm hops, overlaps the analysis window at dk bins
    distance.  Cells of at least ``floor`` of the strongest are kept and scaled to sum 1; distances count from the
    middle of the kept range, whose sides have an odd number of cells.
    """
    t = np.arange(win)
    hann = 0.5 - 0.5 * np.cos(2.0 * np.pi * t / win)
    per_phase = np.bincount(t % hop, hann**2)
    dual = hann / np.maximum(per_phase[t % hop], 1e-8)
    moves = np.arange(0, win - n_fft % 2 + 1, hop) - n_fft // 2
    at = moves[:, None] + np.arange(n_fft)
    overlap = np.where((at >= 0) & (at < win), dual[np.clip(at, 0, win - 1)], 0.0) * FR.window_values(win, n_fft)
    strength = np.abs(np.fft.fft(overlap, axis=1))
    m, k = np.nonzero(strength >= floor * max(strength.max(), 1e-8))
    if not len(m):
        return ((0, 0, 1.0),)
    weight = strength[m, k] / max(strength[m, k].sum(), 1e-8)
    signed = np.where(k < (n_fft + 1) // 2, k, k - n_fft)
    middle = lambda v: v.min() + (v.max() - v.min() + 1) // 2
    return tuple(zip((middle(signed) - signed).tolist(), (middle(m) - m).tolist(), weight.tolist()))


def repro_kernel(spark: SparkSession, n_fft: int, win: int, hop: int, floor: float = 1e-3) -> DataFrame:
    """Kernel table (dk, dm, w): a mask cell at (bin, frame) adds ``w`` at (bin + dk, frame + dm)."""
    return spark.createDataFrame(list(kernel_values(n_fft, win, hop, floor)), "dk int, dm int, w double")


_SMOOTHED = T.ArrayType(
    T.StructType([T.StructField("bin", T.ArrayType(T.IntegerType())), T.StructField("mask", T.ArrayType(T.DoubleType()))])
)
_ROWS = 256


def _spread(cells: list[np.ndarray], kernel: np.ndarray, n_bins: int) -> list[dict[str, np.ndarray]]:
    """Sum of the kernel moved to every cell of a call, limited to 1; dense only for a block of frames at a time."""
    sizes = np.array([len(c) for c in cells], dtype=np.int64)
    at = np.repeat(np.arange(len(cells)), sizes)
    bins = np.concatenate(cells).astype(np.int64) if len(at) else np.zeros(0, np.int64)
    dk, dm, w = kernel[:, 0].astype(np.int64), kernel[:, 1].astype(np.int64), kernel[:, 2]
    out = []
    for first in range(0, len(cells), _ROWS):
        rows = min(_ROWS, len(cells) - first)
        near = slice(*np.searchsorted(at, [first - dm.max(), first + rows - dm.min()]))
        row, col = at[near, None] + dm - first, bins[near, None] + dk
        inside = (row >= 0) & (row < rows) & (col >= 0) & (col < n_bins)
        total = np.bincount((row * n_bins + col)[inside], np.broadcast_to(w, row.shape)[inside], rows * n_bins)
        total = np.minimum(total.reshape(rows, n_bins), 1.0)
        for line in total:
            on = np.flatnonzero(line)
            out.append({"bin": on.astype(np.int32), "mask": line[on]})
    return out


def smooth_calls(calls: DataFrame, kernel: Sequence[tuple[int, int, float]], n_bins: int) -> DataFrame:
    """Spread each call's mask cells (call_id, cells: bins per frame) with the kernel and limit the sum to 1.

    A call is one row, so nothing is shuffled: (call_id, frame_idx, bins, weights), the cells of a frame in order.
    """
    table = np.array(kernel, dtype=float)

    @F.pandas_udf(_SMOOTHED)
    def run(cells: pd.Series) -> pd.Series:
        return cells.map(lambda c: _spread(list(c), table, n_bins))

    spread = calls.select("call_id", F.posexplode(run("cells")).alias("frame_idx", "s"))
    return spread.select("call_id", "frame_idx", F.col("s.bin").alias("bins"), F.col("s.mask").alias("weights"))


def long_mask(packed: DataFrame) -> DataFrame:
    """Cells of a packed mask as rows (call_id, frame_idx, bin, mask)."""
    return packed.select("call_id", "frame_idx", F.explode(F.arrays_zip("bins", "weights")).alias("z")).select(
        "call_id", "frame_idx", F.col("z.bins").alias("bin"), F.col("z.weights").alias("mask")
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _scatter(mags: pd.Series, bins: pd.Series, weights: pd.Series) -> pd.Series:
    """Frame times its mask; a linear-time scatter, which array lookups cannot do."""

    def one(m, b, w):
        out = np.zeros(len(m))
        if b is not None and len(b):
            out[np.asarray(b, dtype=np.int64)] = np.asarray(w, dtype=float)
        return out * np.asarray(m, dtype=float)

    return pd.Series([one(m, b, w) for m, b, w in zip(mags, bins, weights)])


def apply_mask(frames: DataFrame, mask: DataFrame, p: float = 1.0) -> DataFrame:
    """Masked frames ``(mags * mask) ** p`` for a packed mask; frames without mask cells become 0."""
    joined = frames.join(mask.select("call_id", "frame_idx", "bins", "weights"), ["call_id", "frame_idx"], "left")
    out = joined.select("call_id", "frame_idx", "time", _scatter("mags", "bins", "weights").alias("mags"))
    return FR.frame_power(out, p)


def contour_mask(
    contour: DataFrame, wf: DataFrame, cfg: FR.SpectrogramConfig, k_max: int = 32, width: int = 1, floor: float = 1e-3, col: str = "f0"
) -> DataFrame:
    """Smoothed harmonic mask of a contour on the frames of ``cfg``, packed per frame (see ``smooth_calls``).

    The number of frames follows from the number of samples, so no spectrum is computed for it.
    """
    bins = lambda f0: mask_bins(f0, cfg.sr, cfg.n_fft, cfg.n_fft // 2 + 1, k_max, width)
    f0 = _f0_arrays(contour, FR.frame_counts(wf, cfg), col)
    calls = f0.select("call_id", F.transform("f0", bins).alias("cells"))
    return smooth_calls(calls, kernel_values(cfg.n_fft, cfg.win, cfg.hop, floor), cfg.n_fft // 2 + 1)


def masked_spectrogram(
    wf: DataFrame, contour: DataFrame, cfg: FR.SpectrogramConfig, k_max: int = 32, width: int = 1, strategy: str = "arrow"
) -> tuple[DataFrame, DataFrame]:
    """Masked spectrum frames and the smoothed mask itself (packed)."""
    mask = contour_mask(contour, wf, cfg, k_max, width)
    return apply_mask(FR.spectrum(wf, cfg, strategy), mask, cfg.power), mask


def masked_aud_spectrogram(
    wf: DataFrame, contour: DataFrame, cfg: FR.SpectrogramConfig, k_max: int = 32, width: int = 1, strategy: str = "arrow"
) -> DataFrame:
    frames, _ = masked_spectrogram(wf, contour, cfg, k_max, width, strategy)
    return FR.map_frames(frames, cfg.matrix())


def masked_cepstra(
    wf: DataFrame,
    contour: DataFrame,
    cfg: FR.SpectrogramConfig,
    n: int = 40,
    log: bool = True,
    k_max: int = 32,
    width: int = 1,
    strategy: str = "arrow",
) -> DataFrame:
    spec = masked_aud_spectrogram(wf, contour, cfg, k_max, width, strategy)
    return FR.cepstra(spec, len(cfg.matrix()), n, log)
