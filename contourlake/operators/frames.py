"""Framing, short-time Fourier transform, auditory filterbanks on spectra, cepstra, resampling.

Two interchangeable strategies produce the same rows: ``expr`` keeps everything in Catalyst (array slices
and constant sparse maps, good for narrow bands and short windows), ``arrow`` runs ``numpy.fft.rfft`` over
Arrow batches of calls.  Neither one shuffles: a call is one row and its frames are made where it lies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import exprs as X
from ..functions import scales as S

FRAME_SCHEMA = "call_id bigint, frame_idx int, time double, mags array<double>"


def pad_samples(samples: Column, p: int, mode: str) -> Column:
    """Pad both ends by ``p`` samples: zero, reflect (edge not repeated), circular or none."""
    if mode == "none" or p == 0:
        return samples
    if mode == "zero":
        z = F.array_repeat(F.lit(0.0), p)
        return F.concat(z, samples, z)
    n = F.size(samples)
    if mode == "reflect":
        short = F.raise_error(F.lit("reflect padding needs more samples than the pad"))
        head = F.reverse(F.slice(samples, 2, p))
        tail = F.reverse(F.slice(samples, n - p, p))
        return F.when(n > p, F.concat(head, samples, tail)).otherwise(short.cast("array<double>"))
    raise ValueError("pad must be one of: zero, reflect, none")


def frames(wf: DataFrame, n: int, hop: int, center: bool = True, pad: str = "zero") -> DataFrame:
    """Overlapping frames (call_id, frame_idx, frame) of length ``n`` every ``hop`` samples."""

    def cut(x: Column) -> Column:
        count = F.floor((F.size(x) - n) / hop).cast("int") + 1
        return F.transform(A.seq(F.greatest(count, F.lit(0))), lambda m: F.slice(x, m * hop + 1, n))

    padded = pad_samples(F.col("samples"), n // 2 if center else 0, pad)
    return wf.select("call_id", F.posexplode(A.let(padded, cut)).alias("frame_idx", "frame"))


def window_values(win: int, n_fft: int) -> np.ndarray:
    """Periodic Hann of ``win`` samples centred in ``n_fft``."""
    if win > n_fft:
        raise ValueError("the window must not be longer than n_fft")
    out = np.zeros(n_fft)
    start = (n_fft - win) // 2
    out[start : start + win] = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(win) / win)
    return out


def stft_axis(sr: float, n_fft: int, fmin: float = 0.0, fmax: float | None = None) -> tuple[list[float], int]:
    """Frequencies of the kept bins and the number of the first one."""
    fmax = sr / 2 if fmax is None else fmax
    bins = [k for k in range(n_fft // 2 + 1) if fmin <= k * sr / n_fft <= fmax]
    if not bins:
        raise ValueError(f"no frequency bins in range {fmin}-{fmax} Hz")
    return [k * sr / n_fft for k in bins], bins[0]


def stft(
    wf: DataFrame,
    sr: float,
    n_fft: int,
    hop: int,
    win: int | None = None,
    fmin: float = 0.0,
    fmax: float | None = None,
    pad: str = "zero",
    center: bool = True,
    normalized: bool = False,
    highpass: float = 0.0,
    strategy: str = "arrow",
    window: np.ndarray | None = None,
) -> DataFrame:
    """Magnitude frames (call_id, frame_idx, time, mags) over the bins inside [fmin, fmax].

    ``highpass`` applies the zero-phase Butterworth gain in the spectrum; ``window`` replaces the Hann window.
    """
    axis, first = stft_axis(sr, n_fft, fmin, fmax)
    w = window_values(win or n_fft, n_fft) if window is None else np.asarray(window, dtype=float)
    scale = 1.0 / math.sqrt(n_fft) if normalized else 1.0
    gain = scale * np.array(
        [1.0 if highpass <= 0 else _butterworth_gain(f, highpass, sr) for f in axis], dtype=float
    )
    if strategy == "expr":
        k = np.arange(first, first + len(axis))[:, None]
        phase = 2.0 * np.pi * k * np.arange(n_fft)[None, :] / n_fft
        basis = np.concatenate([np.cos(phase) * w * gain[:, None], np.sin(phase) * w * gain[:, None]])
        spec = frames(wf, n_fft, hop, center, pad).select(
            "call_id", "frame_idx", A.linear_map_frame(F.col("frame"), basis).alias("s")
        )
        b = len(axis)
        mags = F.zip_with(F.slice("s", 1, b), F.slice("s", b + 1, b), lambda re, im: F.sqrt(re * re + im * im))
        return spec.select("call_id", "frame_idx", X.frame_time("frame_idx", hop, sr).alias("time"), mags.alias("mags"))
    if strategy != "arrow":
        raise ValueError("strategy must be 'expr' or 'arrow'")
    p = n_fft // 2 if center else 0
    mode = {"zero": "constant", "reflect": "reflect", "none": None}[pad]

    def run(batches):
        for pdf in batches:
            for call_id, samples in zip(pdf["call_id"], pdf["samples"]):
                x = np.asarray(samples, dtype=float)
                if p and mode == "reflect" and len(x) <= p:
                    raise ValueError("reflect padding needs more samples than the pad")
                if p and mode:
                    x = np.pad(x, p, mode=mode)
                if len(x) < n_fft:
                    continue
                cut = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
                spec = np.abs(np.fft.rfft(cut * w, axis=1)[:, first : first + len(axis)]) * gain
                idx = np.arange(len(spec), dtype=np.int32)
                yield pd.DataFrame({"call_id": call_id, "frame_idx": idx, "time": idx * hop / sr, "mags": list(spec)})

    return wf.select("call_id", "samples").mapInPandas(run, FRAME_SCHEMA)


SEGMENT_BITS = 20


def segment_calls(wf: DataFrame, n_fft: int, hop: int, frames_per_segment: int, center: bool = True, pad: str = "zero") -> DataFrame:
    """Cut calls into rows of bounded length: (call_id, samples), the segment's number in the low bits of call_id.

    Segment k holds the samples of frames [k * frames_per_segment, (k + 1) * frames_per_segment), so neighbours overlap
    by n_fft - hop samples and no frame is lost.  The padding of the call's ends is part of its first and last segment;
    transform segments without centring.  Call ids must fit 43 bits.
    """
    span = (frames_per_segment - 1) * hop + n_fft

    def cut(x: Column) -> Column:
        count = F.greatest(F.floor((F.size(x) - n_fft) / hop).cast("int") + 1, F.lit(0))
        parts = F.ceil(count / frames_per_segment).cast("int")
        return F.transform(A.seq(parts), lambda k: F.slice(x, k * (frames_per_segment * hop) + 1, span))

    padded = pad_samples(F.col("samples"), n_fft // 2 if center else 0, pad)
    rows = wf.select("call_id", F.posexplode(A.let(padded, cut)).alias("k", "samples"))
    return rows.select((F.shiftleft(F.col("call_id").cast("long"), SEGMENT_BITS) + F.col("k")).alias("call_id"), "samples")


def stft_segmented(
    wf: DataFrame, sr: float, n_fft: int, hop: int, frames_per_segment: int = 4096, center: bool = True, pad: str = "zero", **options
) -> DataFrame:
    """``stft`` of long recordings through bounded segments: the same frames, stitched by number."""
    parts = stft(segment_calls(wf, n_fft, hop, frames_per_segment, center, pad), sr, n_fft, hop, center=False, pad="none", **options)
    k = F.col("call_id").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1).cast("long"))
    idx = (k * frames_per_segment + F.col("frame_idx")).cast("int")
    placed = parts.select(F.shiftright("call_id", SEGMENT_BITS).alias("call_id"), idx.alias("frame_idx"), "mags")
    return placed.select("call_id", "frame_idx", X.frame_time("frame_idx", hop, sr).alias("time"), "mags")


def _butterworth_gain(f: float, cutoff: float, sr: float, order: int = 5) -> float:
    if f <= 0:
        return 0.0
    if f >= sr / 2:
        return 1.0
    fc = min(cutoff, 0.99 * sr / 2.0)
    return 1.0 / (1.0 + (math.tan(math.pi * fc / sr) / math.tan(math.pi * f / sr)) ** (2 * order))


def explode_frames(tf_frame: DataFrame, axis: list[float]) -> DataFrame:
    """Dense frames to the long grid (call_id, frame_idx, time, channel, freq_hz, magnitude)."""
    return tf_frame.select(
        "call_id", "frame_idx", "time", F.posexplode("mags").alias("channel", "magnitude")
    ).withColumn("freq_hz", F.get(A.dlit(axis), F.col("channel")))


def pack_frames(tf: DataFrame) -> DataFrame:
    """Long grid to dense frames, channels in order; the group is one frame of bounded width."""
    return tf.groupBy("call_id", "frame_idx").agg(
        F.min("time").alias("time"),
        F.transform(F.sort_array(F.collect_list(F.struct("channel", "magnitude"))), lambda s: s["magnitude"]).alias(
            "mags"
        ),
    )


def by_call(df: DataFrame) -> DataFrame:
    """Hash-partition by call into the session's shuffle partitions.

    The grouping that follows reuses this exchange.  The explicit number keeps adaptive execution from merging
    small partitions: a packed call is little data but much work.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "call_id")


def pack_calls(tf_frame: DataFrame, name: str = "frames") -> DataFrame:
    """Dense frames to one row per call: (call_id, times, frames)."""
    packed = F.sort_array(F.collect_list(F.struct("frame_idx", "time", "mags")))
    return (
        by_call(tf_frame)
        .groupBy("call_id")
        .agg(packed.alias("p"))
        .select(
            "call_id",
            F.transform("p", lambda s: s["time"]).alias("times"),
            F.transform("p", lambda s: s["mags"]).alias(name),
        )
    )


@dataclass(frozen=True)
class MultiResConfig:
    """Two short-time transforms with a common hop."""

    sr: int = 16000
    hop: int = 256
    coarse_n_fft: int = 32768
    coarse_win: int = 8192
    fine_n_fft: int = 32768
    fine_win: int = 8192
    fmin: float = 5.0
    fmax: float = 500.0

    def __post_init__(self) -> None:
        for n_fft, win in ((self.coarse_n_fft, self.coarse_win), (self.fine_n_fft, self.fine_win)):
            if n_fft <= 0 or win <= 0:
                raise ValueError("n_fft and window lengths must be positive")
            if win > n_fft:
                raise ValueError("a window must not be longer than its n_fft")
        if self.hop <= 0:
            raise ValueError("hop must be positive")
        if self.fmax <= self.fmin:
            raise ValueError("fmax must be greater than fmin")


def multires_stft(wf: DataFrame, cfg: MultiResConfig, strategy: str = "arrow") -> DataFrame:
    """Aligned coarse and fine frames per call: (call_id, times, coarse, fine).

    Equal settings give one transform.  Otherwise both are packed per call and joined; a call whose frame
    axes differ is an error.
    """

    def one(n_fft: int, win: int) -> DataFrame:
        return stft(wf, cfg.sr, n_fft, cfg.hop, win, cfg.fmin, cfg.fmax, strategy=strategy)

    coarse = pack_calls(one(cfg.coarse_n_fft, cfg.coarse_win), "coarse")
    if (cfg.coarse_n_fft, cfg.coarse_win) == (cfg.fine_n_fft, cfg.fine_win):
        return coarse.withColumn("fine", F.col("coarse"))
    fine = pack_calls(one(cfg.fine_n_fft, cfg.fine_win), "fine").withColumnRenamed("times", "fine_times")
    both = coarse.join(fine, "call_id", "full_outer")
    aligned = (
        F.col("times").isNotNull()
        & F.col("fine_times").isNotNull()
        & (F.size("times") == F.size("fine_times"))
    )
    bad = F.raise_error(F.lit("coarse and fine frame axes do not align")).cast("array<double>")
    return both.select("call_id", F.when(aligned, F.col("times")).otherwise(bad).alias("times"), "coarse", "fine")


def tri_matrix(
    n_freqs: int,
    fmin: float,
    fmax: float,
    n: int,
    sr: float,
    scale: str = "elelog",
    norm: str | None = None,
    drop_empty: bool = True,
) -> np.ndarray:
    """Triangular filters (filters x bins) equally spaced on an auditory scale."""
    if norm not in (None, "slaney"):
        raise ValueError("norm must be None or 'slaney'")
    if scale == "elelog":
        fmin = max(fmin, 1.0)
    edges = _points(fmin, fmax, n + 2, scale)
    if scale == "elelog" and fmin <= 1:
        edges[0] = 0.0
    freqs = np.linspace(0.0, sr // 2, n_freqs)
    up = (freqs[None, :] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - freqs[None, :]) / np.diff(edges)[1:, None]
    out = np.maximum(0.0, np.minimum(up, down))
    if norm == "slaney":
        out *= (2.0 / (edges[2:] - edges[:-2]))[:, None]
    return out[out.sum(axis=1) > 0] if drop_empty else out


def _points(lo: float, hi: float, n: int, scale: str) -> np.ndarray:
    """Equally spaced points without forced end values (round trip through the scale)."""
    return np.array(S.axis_values(lo, hi, n, scale))


def tri_fb(spark: SparkSession, n_freqs: int, fmin: float, fmax: float, n: int, sr: float, **kw) -> DataFrame:
    """The same filters as a sparse table (filter, bin, weight)."""
    m = tri_matrix(n_freqs, fmin, fmax, n, sr, **kw)
    rows = [(int(f), int(b), float(m[f, b])) for f, b in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "filter int, bin int, weight double")


@dataclass(frozen=True)
class SpectrogramConfig:
    sr: int = 16000
    n_fft: int = 8192
    win: int = 8192
    hop: int = 320
    fmin: float = 5.0
    fmax: float = 1000.0
    n_filters: int = 1024
    power: float = 1.0
    normalized: bool = False
    center: bool = True
    pad: str = "reflect"
    norm: str | None = None
    scale: str = "elelog"
    drop_empty: bool = True

    def matrix(self) -> np.ndarray:
        return tri_matrix(
            self.n_fft // 2 + 1, self.fmin, self.fmax, self.n_filters, self.sr, self.scale, self.norm, self.drop_empty
        )


def spectrum(wf: DataFrame, cfg: SpectrogramConfig, strategy: str = "arrow") -> DataFrame:
    return stft(
        wf,
        cfg.sr,
        cfg.n_fft,
        cfg.hop,
        cfg.win,
        pad=cfg.pad,
        center=cfg.center,
        normalized=cfg.normalized,
        strategy=strategy,
    )


def frame_counts(wf: DataFrame, cfg: SpectrogramConfig) -> DataFrame:
    """Frames per call (call_id, n) by arithmetic on the number of samples; calls without a frame are left out."""
    padded = F.size("samples") + (2 * (cfg.n_fft // 2) if cfg.center and cfg.pad != "none" else 0)
    n = (F.floor((padded - cfg.n_fft) / cfg.hop) + 1).cast("int")
    return wf.select("call_id", n.alias("n")).filter("n > 0")


def frame_power(tf_frame: DataFrame, p: float) -> DataFrame:
    if p == 1.0:
        return tf_frame
    return tf_frame.withColumn("mags", F.transform("mags", lambda m: F.pow(F.abs(m), F.lit(float(p)))))


def map_frames(tf_frame: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Replace every frame by ``matrix @ frame``."""
    mapped = A.linear_map(F.array("mags"), matrix).getItem(0)
    return tf_frame.select("call_id", "frame_idx", "time", mapped.alias("mags"))


def aud_spectrogram(wf: DataFrame, cfg: SpectrogramConfig, strategy: str = "arrow") -> DataFrame:
    """Spectrum -> power -> triangular filters; ``scale='mel'`` is the ordinary mel spectrogram."""
    return map_frames(frame_power(spectrum(wf, cfg, strategy), cfg.power), cfg.matrix())


def dct_matrix(n_out: int, n_in: int, dct_type: int = 2, norm: str | None = "ortho") -> np.ndarray:
    if dct_type != 2:
        raise ValueError("only DCT type 2 is supported")
    m = np.cos(np.pi / n_in * np.outer(np.arange(n_out), np.arange(n_in) + 0.5))
    if norm == "ortho":
        m *= math.sqrt(2.0 / n_in)
        m[0] /= math.sqrt(2.0)
    return m


def cepstra(spec: DataFrame, n_in: int, n: int = 40, log: bool = False, dct_type: int = 2) -> DataFrame:
    """First ``n`` cosine coefficients of every frame, of the logarithm when ``log``."""
    if log:
        spec = spec.withColumn("mags", F.transform("mags", lambda m: F.log(m + 1e-10)))
    return map_frames(spec, dct_matrix(n, n_in, dct_type))


def to_samples(wf: DataFrame) -> DataFrame:
    """Waveform table to the long form (call_id, n, x)."""
    return wf.select("call_id", F.posexplode("samples").alias("n", "x"))


def to_mono(df: DataFrame) -> DataFrame:
    """Average the channels: ``samples`` is an array of equally long channel arrays."""
    first = F.get("samples", F.lit(0))
    mono = F.transform(first, lambda _, i: A.array_sum(F.transform("samples", lambda ch: F.get(ch, i))) / F.size("samples"))
    return df.withColumn("samples", mono)


def pad_min(wf: DataFrame, n: int) -> DataFrame:
    """Append zeros until a call has at least ``n`` samples."""
    missing = F.greatest(F.lit(n) - F.size("samples"), F.lit(0))
    return wf.withColumn("samples", F.concat("samples", F.array_repeat(F.lit(0.0), missing)))


def resample(wf: DataFrame, sr_in: int, sr_out: int, taps: int = 16) -> DataFrame:
    """Rate conversion by a Hann-windowed sinc of ``2 * taps`` input samples per output sample.

    With integer rates only ``sr_out / gcd`` fractional positions exist, so the weights form a small
    constant table and an output sample is a short dot product of array elements.
    """
    g = math.gcd(sr_in, sr_out)
    up, down = sr_out // g, sr_in // g
    cut = min(1.0, sr_out / sr_in)
    offsets = np.arange(-taps + 1, taps + 1)
    table = []
    for ph in range(up):
        d = offsets - (ph * down % up) / up
        win = 0.5 + 0.5 * np.cos(np.pi * np.clip(d / taps, -1.0, 1.0))
        table.append(cut * np.sinc(cut * d) * win)
    weights = A.constant([[float(v) for v in row] for row in table], "array<array<double>>")
    offs = A.ilit([int(o) for o in offsets])

    def build(x: Column) -> Column:
        n_out = F.ceil(F.size(x) * sr_out / sr_in).cast("int")

        def one(m: Column) -> Column:
            base = F.floor(m.cast("bigint") * down / up).cast("int")
            row = F.get(weights, (m % up).cast("int"))
            prod = F.zip_with(offs, row, lambda o, w: w * F.coalesce(F.when(base + o >= 0, F.get(x, base + o)), F.lit(0.0)))
            return A.array_sum(prod)

        return F.transform(A.seq(n_out), one)

    return wf.select("call_id", F.lit(sr_out).alias("sr"), A.let(F.col("samples"), build).alias("samples"))


