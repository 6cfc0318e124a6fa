"""Hybrid tracker: harmonic evidence lattice, restricted-band proposals, gated path search.

Everything that is linear in a frame (envelope removal, harmonic and inter-harmonic sums, smoothed harmonic
power) is folded into one constant matrix per lattice, computed from the axes on the driver; a lattice is
then a single pass over the frames.  Robust statistics and paths are array expressions per call.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..functions import exprs as X
from ..functions import series as R
from . import filterbank as FB
from . import frames as FR
from . import lookup as L
from . import track as TR

# Fixed values of the tracker.
GATED_OUT = -1e6
MARGIN_LIMIT = 12.0
EXCLUSION_HZ = 0.75
DUPLICATE_HZ = 0.5
ROUGHNESS_WEIGHT = 0.05
COMPONENTS = ("hybrid", "ridge", "shrp", "power", "hybrid_power")


@dataclass(frozen=True)
class HybridConfig:
    h1_min: float = 17.0
    h1_max: float = 82.0
    candidate_step: float = 0.1
    band_width: float = 36.0
    bands: tuple[tuple[float, float], ...] = ((17.0, 30.0), (22.5, 40.0), (30.0, 58.0), (50.0, 82.0))
    anchor_threshold: float = 22.5
    proposal_jump: float = 1.5
    ridge_vote: float = 0.35
    radius: float = 0.5
    n_harmonics: int = 24
    harmonic_exp: float = 0.35
    bin_radius: int = 1
    ridge_weight: float = 0.65
    inter_penalty: float = 0.30
    contrast_sigma: float = 8.0
    smoothness: float = 0.04
    transition_scale: float = 0.1
    max_jump: float = 1.5

    def candidates(self) -> list[float]:
        n = int(np.ceil((self.h1_max + 0.5 * self.candidate_step - self.h1_min) / self.candidate_step - 1e-12))
        return [self.h1_min + i * self.candidate_step for i in range(n)]


# ---------------------------------------------------------------- robust statistics


def _floor(frames: Column, factor: float) -> Column:
    """Small fraction of the median positive cell of the call."""
    positive = F.filter(F.flatten(frames), lambda x: x > 0)
    return F.coalesce(A.median(positive) * factor, F.lit(1e-12))


def floored_log(frames: Column, factor: float = 1e-6) -> Column:
    return A.let(
        F.struct(frames.alias("f"), _floor(frames, factor).alias("e")),
        lambda s: F.transform(s["f"], lambda fr: F.transform(fr, lambda x: F.log(F.greatest(x, s["e"])))),
    )


def contrast_matrix(n: int, sigma: float) -> np.ndarray:
    """Frame minus its Gaussian envelope."""
    return np.eye(n) - A.smoothing_matrix(n, A.gaussian_weights(max(float(sigma), 0.5)))


def scaled_contrast(raw: Column) -> Column:
    """Divide each frame by its 75th percentile of magnitudes (floored by the call) and limit."""

    def run(v: Column) -> Column:
        scale = F.transform(v, lambda fr: A.percentile(F.transform(fr, F.abs), 0.75))

        def divide(q: Column) -> Column:
            floor = F.greatest(A.median(q) * 0.1, F.lit(1e-6))
            return A.let(
                floor,
                lambda fl: F.zip_with(
                    v,
                    q,
                    lambda fr, s: A.let(F.greatest(s, fl), lambda d: F.transform(fr, lambda x: A.clip(x / d, -4.0, 6.0))),
                ),
            )

        return A.let(scale, divide)

    return A.let(raw, run)


def contrast(frames: Column, n: int, sigma: float) -> Column:
    """Local spectral contrast of every frame of a call."""
    return scaled_contrast(A.linear_map(floored_log(frames), contrast_matrix(n, sigma)))


def robust_z(lattice: Column) -> Column:
    """Per-frame (x - median) / max(1.4826 MAD, floor), limited to [-8, 12]; the floor follows the call."""

    def run(v: Column) -> Column:
        def centre(fr: Column) -> Column:
            return A.let(
                A.median(fr),
                lambda m: F.struct(m.alias("m"), A.median(F.transform(fr, lambda x: F.abs(x - m))).alias("d")),
            )

        def scale(q: Column) -> Column:
            floor = F.greatest(A.median(F.transform(q, lambda s: s["d"])) * 0.1, F.lit(1e-5))
            return A.let(
                floor,
                lambda fl: F.zip_with(
                    v,
                    q,
                    lambda fr, s: A.let(
                        F.greatest(s["d"] * 1.4826, fl),
                        lambda d: F.transform(fr, lambda x: A.clip((x - s["m"]) / d, -8.0, 12.0)),
                    ),
                ),
            )

        return A.let(F.transform(v, centre), scale)

    return A.let(lattice, run)


# ---------------------------------------------------------------- lattices


@dataclass(frozen=True)
class LatticeMaps:
    """Constant matrices from channels to candidates."""

    ridge: np.ndarray
    shrp: np.ndarray
    power: np.ndarray


def lattice_maps(axis: list[float], cfg: HybridConfig) -> LatticeMaps:
    h1 = np.array(cfg.candidates())
    n = len(axis)
    ridge, _ = A.interp_matrix(axis, h1)

    def stack(shift: float) -> np.ndarray:
        total, weight = np.zeros((len(h1), n)), np.zeros(len(h1))
        for k in range(2, cfg.n_harmonics + 1):
            w = float(k) ** -cfg.harmonic_exp
            m, valid = A.interp_matrix(axis, (k + shift) * 0.5 * h1)
            total += w * m
            weight += w * valid
        return total / np.maximum(weight, 1e-12)[:, None]

    harmonic = stack(0.0)
    box = np.full(2 * cfg.bin_radius + 1, 1.0 / (2 * cfg.bin_radius + 1))
    return LatticeMaps(ridge, harmonic - cfg.inter_penalty * stack(0.5), harmonic @ A.smoothing_matrix(n, box))


def power_lattice(frames: Column, maps: LatticeMaps) -> Column:
    """Floored logarithm of weighted harmonic power at every candidate."""
    squared = F.transform(frames, lambda fr: F.transform(fr, lambda x: x * x))
    return floored_log(A.linear_map(squared, maps.power), 1e-8)


def with_lattices(calls: DataFrame, axis: list[float], cfg: HybridConfig, frames: str = "frames") -> DataFrame:
    """Add ridge, shrp, anchor and power lattices to packed calls (frames of candidate scores)."""
    maps = lattice_maps(axis, cfg)
    c = calls.withColumn("_log", floored_log(F.col(frames)))
    c = c.withColumn("_contrast", scaled_contrast(A.linear_map(F.col("_log"), contrast_matrix(len(axis), cfg.contrast_sigma))))
    return (
        c.withColumn("ridge", A.linear_map(F.col("_contrast"), maps.ridge))
        .withColumn("shrp", A.linear_map(F.col("_contrast"), maps.shrp))
        .withColumn("anchor", A.linear_map(F.col("_log"), maps.ridge))
        .withColumn("power", power_lattice(F.col(frames), maps))
        .drop("_log", "_contrast")
    )


def emission(component: str, cfg: HybridConfig) -> Column:
    """Chosen emission over the columns ridge, shrp and power."""
    ridge, shrp, power = F.col("ridge"), F.col("shrp"), F.col("power")

    def blend(other: Column) -> Column:
        return F.zip_with(
            robust_z(ridge),
            robust_z(other),
            lambda a, b: F.zip_with(a, b, lambda x, y: x * cfg.ridge_weight + y),
        )

    table = {"ridge": ridge, "shrp": shrp, "power": power}
    if component in table:
        return table[component]
    if component == "hybrid":
        return blend(shrp)
    if component == "hybrid_power":
        return blend(power)
    raise ValueError(f"no component named {component!r}; known are {sorted(COMPONENTS)}")


# ---------------------------------------------------------------- bands and proposals


def _profile(lattice: Column) -> Column:
    """Upper quartile over time of every candidate."""
    return A.let(
        lattice,
        lambda v: F.transform(
            F.get(v, F.lit(0)), lambda _, s: A.percentile(F.transform(v, lambda fr: F.get(fr, s)), 0.75)
        ),
    )


def select_band(anchor: Column, shrp: Column, cfg: HybridConfig, width: float | None = None) -> Column:
    """Struct (low, high): band around the anchor, its half or its double, whichever has the best evidence."""
    h1 = cfg.candidates()
    width = cfg.band_width if width is None else width
    if width <= 0 or width >= h1[-1] - h1[0]:
        return F.struct(F.lit(h1[0]).alias("low"), F.lit(h1[-1]).alias("high"))
    axis = A.dlit(h1)

    def score(s: Column) -> Column:
        prof, ev = s["a"], s["e"]
        med = A.median(prof)

        def ranked(m: Column) -> Column:
            spread = F.greatest(A.median(F.transform(prof, lambda x: F.abs(x - m))) * 1.4826, F.lit(1e-6))
            top = F.get(axis, A.first_max(prof))

            def pick(q: Column) -> Column:
                tries = F.filter(
                    F.transform(A.dlit([0.5, 1.0, 2.0]), lambda r: r * q["top"]),
                    lambda v: (v >= h1[0]) & (v <= h1[-1]),
                )
                idx = F.array_sort(F.array_distinct(F.transform(tries, lambda v: L.nearest_index(axis, v))))
                scored = F.transform(
                    idx,
                    lambda i: F.struct((F.get(ev, i) + (F.get(prof, i) - m) / q["spread"] * 0.35).alias("v"), (-i).alias("ni")),
                )
                return F.get(axis, -F.array_max(scored)["ni"])

            return A.let(F.struct(top.alias("top"), spread.alias("spread")), pick)

        return A.let(med, ranked)

    centre = A.let(F.struct(_profile(anchor).alias("a"), _profile(robust_z(shrp)).alias("e")), score)

    def edges(c: Column) -> Column:
        lo = F.greatest(c - 0.5 * width, F.lit(h1[0]))
        hi = F.least(c + 0.5 * width, F.lit(h1[-1]))
        return A.let(
            F.struct(lo.alias("l"), hi.alias("h")),
            lambda b: A.let(
                F.filter(axis, lambda v: (v >= b["l"]) & (v <= b["h"])),
                lambda k: F.struct(F.array_min(k).alias("low"), F.array_max(k).alias("high")),
            ),
        )

    return A.let(centre, edges)


def _band_table(axis: list[float], bands: list[tuple[float, float]], jump: float) -> Column:
    """Constant array of search bands: limits, channels, their frequencies and what each channel can reach."""
    rows = []
    for low, high in bands:
        first, n = X.band_channels(axis, low, high)
        if n < 3:
            raise ValueError(f"too few channels in proposal band {(low, high)}")
        hz = [float(f) for f in axis[first : first + n]]
        lo, hi = TR._reach(hz, jump)
        rows.append({"low": low, "high": high, "first": first, "n": n, "hz": hz, "lo": lo, "hi": hi})
    return A.constant(
        rows, "array<struct<low:double,high:double,first:int,n:int,hz:array<double>,lo:array<int>,hi:array<int>>>"
    )


def _band_path(frames: Column, band: Column) -> Column:
    cut = F.transform(frames, lambda fr: F.slice(fr, band["first"] + 1, band["n"]))
    return F.transform(TR.outward(cut, band["lo"], band["hi"]), lambda c: F.get(band["hz"], c))


def coarse_path(frames: Column, axis: list[float], band: tuple[float, float], jump: float) -> Column:
    """Ridge path in Hz inside one band, outward from the strongest frame."""
    table = _band_table(axis, [band], jump)
    return A.let(frames, lambda v: F.transform(table, lambda b: _band_path(v, b)).getItem(0))


def with_proposals(
    calls: DataFrame, axis: list[float], cfg: HybridConfig, frames: str = "frames"
) -> DataFrame:
    """Add ``proposals``: array of (band_lo, band_hi, path, median_h1, shrp_score, ridge_score, roughness, score).

    A band whose path stays within half a hertz of an earlier kept one is dropped.  ``frames`` are the frames
    the paths follow; the evidence comes from the anchor and shrp lattices.
    """
    h1 = A.dlit(cfg.candidates())
    bands = [(max(lo, cfg.h1_min), min(hi, cfg.h1_max)) for lo, hi in cfg.bands]
    bands = [(lo, hi) for lo, hi in bands if hi > lo]
    if not bands:
        raise ValueError("no valid proposal bands")
    table = _band_table(axis, bands, cfg.proposal_jump)

    def describe(s: Column, band: Column, p: Column) -> Column:
        return A.let(
            F.struct(
                A.median(L.sample_path(s["s"], h1, p)).alias("s"),
                A.median(L.sample_path(s["a"], h1, p)).alias("r"),
                R.roughness(p).alias("g"),
            ),
            lambda e: F.struct(
                band["low"].alias("band_lo"),
                band["high"].alias("band_hi"),
                p.alias("path"),
                A.median(p).alias("median_h1"),
                e["s"].alias("shrp_score"),
                e["r"].alias("ridge_score"),
                e["g"].alias("roughness"),
                (e["s"] + e["r"] * cfg.ridge_vote - e["g"] * ROUGHNESS_WEIGHT).alias("score"),
            ),
        )

    evidence = F.struct(
        F.col(frames).alias("f"), robust_z(F.col("anchor")).alias("a"), robust_z(F.col("shrp")).alias("s")
    )
    described = A.let(
        evidence,
        lambda s: F.transform(table, lambda b: A.let(_band_path(s["f"], b), lambda p: describe(s, b, p))),
    )
    return calls.withColumn("proposals", dedupe_proposals(described))


def dedupe_proposals(items: Column) -> Column:
    """Keep a proposal unless an earlier kept path lies within half a hertz (median distance)."""

    def close(a: Column, b: Column) -> Column:
        return A.median(F.zip_with(a["path"], b["path"], lambda x, y: F.abs(x - y))) < DUPLICATE_HZ

    def keep(kept: Column, p: Column) -> Column:
        return F.when(F.exists(kept, lambda k: close(k, p)), kept).otherwise(F.concat(kept, F.array(p)))

    return A.let(
        items,
        lambda v: F.aggregate(F.slice(v, 2, F.size(v)), F.slice(v, 1, 1), keep),
    )


def pick_proposal(frames: Column, axis: list[float], cfg: HybridConfig) -> Column:
    """Index into ``proposals``: nearest median to a broad anchor at or above the threshold, else best score."""
    cut, f = TR.band_frames(frames, axis, cfg.h1_min, cfg.h1_max)
    hz = F.get(A.dlit(f), A.let(cut, lambda v: TR.anchor(v)["channel"]))
    p = F.col("proposals")
    near = A.let(hz, lambda a: A.first_min(F.transform(p, lambda q: F.abs(q["median_h1"] - a))))
    best = A.first_max(F.transform(p, lambda q: q["score"]))
    return F.when(hz >= cfg.anchor_threshold, near).otherwise(best)


# ---------------------------------------------------------------- path search


def gate(lattice: Column, h1: Column, path: Column, radius: float) -> Column:
    """Scores within ``radius`` of the path, a large penalty elsewhere."""
    return F.zip_with(
        lattice,
        path,
        lambda fr, c: F.zip_with(
            fr, h1, lambda x, h: F.when(F.abs(h - c) <= radius, x).otherwise(F.lit(GATED_OUT))
        ),
    )


def _costs(n: int, step: float, smooth: float, scale: float, jump: float) -> np.ndarray:
    r = max(1, int(np.floor(jump / step + 1e-9)))
    return smooth * (np.arange(min(r, n - 1) + 1) * step / max(scale, 1e-9)) ** 2


def viterbi(
    lattice: Column, h1: list[float], smooth: float, scale: float, jump: float, strategy: str = "arrow"
) -> Column:
    """Best path through a call's lattice with bounded quadratic transition cost: struct (idx, hz).

    ``arrow`` runs one vector step per frame, for any number of states; ``expr`` states the same as a fold in
    Catalyst.  Ties go to the highest predecessor and the lowest final state; scores are
    quantised to 1e-9 first, so equal evidence is settled by that rule and not by rounding noise.
    """
    n = len(h1)
    if n < 3:
        raise ValueError("the path search needs at least 3 states")
    step = float(np.median(np.diff(h1)))
    cost = _costs(n, step, smooth, scale, jump)
    search = _viterbi_arrow if strategy == "arrow" else _viterbi_expr
    axis = A.dlit(h1)
    lattice = F.transform(lattice, lambda fr: F.transform(fr, lambda x: F.rint(x * 1e9) / 1e9))

    def refine(s: Column) -> Column:
        def point(fr: Column, i: Column) -> Column:
            off = X.quad_offset(F.get(fr, i - 1), F.get(fr, i), F.get(fr, i + 1), 0.75)
            inner = (i > 0) & (i < n - 1)
            return F.get(axis, i) + F.when(inner, off * step).otherwise(0.0)

        return F.struct(s["i"].alias("idx"), F.zip_with(s["l"], s["i"], point).alias("hz"))

    if strategy == "arrow":
        return A.let(F.struct(search(lattice, cost).alias("i"), lattice.alias("l")), refine)
    return A.let(lattice, lambda v: A.let(F.struct(search(v, cost).alias("i"), v.alias("l")), refine))


def _viterbi_expr(lattice: Column, cost: np.ndarray) -> Column:
    r = len(cost) - 1
    costs = A.dlit(cost)

    def best(dp: Column, s: Column) -> Column:
        lo = F.greatest(s - r, F.lit(0))
        near = F.slice(dp, lo + 1, F.least(s + r, F.size(dp) - 1) - lo + 1)
        return F.array_max(
            F.transform(near, lambda v, i: F.struct((v - F.get(costs, F.abs(lo + i - s))).alias("v"), (lo + i).alias("p")))
        )

    def forward(st: Column, fr: Column) -> Column:
        moves = F.transform(fr, lambda x, s: A.let(best(st["dp"], s), lambda b: F.struct((x + b["v"]).alias("v"), b["p"].alias("p"))))
        return A.let(
            moves,
            lambda m: F.struct(
                F.transform(m, lambda q: q["v"]).alias("dp"),
                F.concat(st["back"], F.array(F.transform(m, lambda q: q["p"]))).alias("back"),
            ),
        )

    def trace(st: Column) -> Column:
        return F.aggregate(
            F.reverse(st["back"]),
            F.array(A.first_max(st["dp"])),
            lambda acc, b: F.concat(F.array(F.get(b, F.get(acc, F.lit(0)))), acc),
        )

    def run(v: Column) -> Column:
        zero = F.struct(F.get(v, F.lit(0)).alias("dp"), F.expr("cast(array() as array<array<int>>)").alias("back"))
        return F.aggregate(F.slice(v, 2, F.size(v)), zero, forward, trace)

    return A.let(lattice, run)


def _viterbi_arrow(lattice: Column, cost: np.ndarray) -> Column:
    r = len(cost) - 1
    # window position j of state s is predecessor s - r + j; reversed so that the first maximum is the highest
    window_cost = np.concatenate([cost[::-1], cost[1:]])

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def search(col: pd.Series) -> pd.Series:
        def one(frames):
            em = np.stack([np.asarray(f, dtype=float) for f in frames])
            dp, back = em[0], []
            rows = np.arange(em.shape[1])
            for fr in em[1:]:
                padded = np.pad(dp, r, constant_values=-np.inf)
                moves = np.lib.stride_tricks.sliding_window_view(padded, 2 * r + 1) - window_cost
                j = 2 * r - np.argmax(moves[:, ::-1], axis=1)
                back.append(rows - r + j)
                dp = fr + moves[rows, j]
            path = [int(np.argmax(dp))]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            return path[::-1]

        return col.map(one)

    return search(lattice)


def path_conf(lattice: Column, h1: list[float], path: Column, exclusion: float = EXCLUSION_HZ) -> Column:
    """Logistic margin of the chosen score over the best rival at least ``exclusion`` Hz away."""
    axis = A.dlit(h1)

    def one(fr: Column, hz: Column) -> Column:
        chosen = F.get(fr, L.nearest_index(axis, hz))
        far = F.filter(F.arrays_zip(fr.alias("x"), axis.alias("h")), lambda z: F.abs(z["h"] - hz) >= exclusion)
        rival = F.array_max(F.transform(far, lambda z: z["x"]))
        return A.let(chosen, lambda c: X.sigmoid_margin(c, F.coalesce(rival, c)))

    return F.zip_with(lattice, path, one)


# ---------------------------------------------------------------- whole trackers


def track_calls(
    calls: DataFrame,
    axis: list[float],
    cfg: HybridConfig,
    component: str = "power",
    path_frames: str = "frames",
    path_axis: list[float] | None = None,
    evidence_frames: str = "frames",
) -> DataFrame:
    """One row per call with the tracked path: arrays h1, confidence and the summary fields."""
    h1 = cfg.candidates()
    path_axis = axis if path_axis is None else path_axis
    c = with_lattices(calls, axis, cfg, evidence_frames)
    c = with_proposals(c, path_axis, cfg, path_frames)
    c = c.withColumn("_z", robust_z(emission(component, cfg))).withColumn(
        "_pick", pick_proposal(F.col(path_frames), path_axis, cfg)
    )
    c = c.withColumn("_coarse", F.get("proposals", F.col("_pick"))["path"])
    c = c.withColumn("_gated", gate(F.col("_z"), A.dlit(h1), F.col("_coarse"), cfg.radius))
    c = c.withColumn("_path", viterbi(F.col("_gated"), h1, cfg.smoothness, cfg.transition_scale, cfg.max_jump))
    med = A.median(F.col("_coarse"))
    chosen = A.let(med, lambda m: A.first_min(F.transform("proposals", lambda q: F.abs(q["median_h1"] - m))))
    c = c.withColumn("_chosen", chosen)

    def margin(s: Column) -> Column:
        others = F.filter(s["p"], lambda q, i: i != s["k"])
        best = F.array_max(F.transform(others, lambda q: q["score"]))
        return F.when(best.isNull(), F.lit(MARGIN_LIMIT)).otherwise(F.get(s["p"], s["k"])["score"] - best)

    gap = A.let(F.struct(F.col("proposals").alias("p"), F.col("_chosen").alias("k")), margin)
    c = c.withColumn("proposal_confidence", X.sigmoid_margin(gap, F.lit(0.0)))
    local = path_conf(F.col("_z"), h1, F.col("_path.hz"))
    conf = A.let(
        F.struct(local.alias("c"), F.col("proposal_confidence").alias("k")),
        lambda s: F.transform(s["c"], lambda x: x * s["k"]),
    )
    lo = F.greatest(F.array_min("_coarse") - cfg.radius, F.lit(cfg.h1_min))
    hi = F.least(F.array_max("_coarse") + cfg.radius, F.lit(cfg.h1_max))
    inside = A.let(
        F.struct(lo.alias("l"), hi.alias("h")),
        lambda b: F.filter(A.dlit(h1), lambda v: (v >= b["l"]) & (v <= b["h"])),
    )
    return c.withColumn("_in", inside).select(
        "call_id",
        "times",
        F.col("_path.hz").alias("h1"),
        conf.alias("confidence"),
        "proposal_confidence",
        F.array_min("_in").alias("band_lo"),
        F.array_max("_in").alias("band_hi"),
    )


def contour_rows(tracked: DataFrame) -> DataFrame:
    """Tracked calls to contour rows (call_id, frame_idx, time, frequency = H1, f0, confidence)."""
    z = F.posexplode(F.arrays_zip("h1", "confidence")).alias("frame_idx", "z")
    return tracked.select("call_id", "times", z).select(
        "call_id",
        "frame_idx",
        F.get("times", F.col("frame_idx")).alias("time"),
        F.col("z.h1").alias("frequency"),
        X.h1_to_f0(F.col("z.h1")).alias("f0"),
        F.col("z.confidence").alias("confidence"),
    )


def track_summary(tracked: DataFrame) -> DataFrame:
    return tracked.select("call_id", "proposal_confidence", "band_lo", "band_hi")


def track_hybrid(calls: DataFrame, axis: list[float], cfg: HybridConfig = HybridConfig(), component: str = "power") -> DataFrame:
    """Hybrid tracker on packed calls (call_id, times, frames)."""
    return track_calls(calls, axis, cfg, component)


def track_hybrid_fb(
    wf: DataFrame, fb: FB.FilterbankConfig, cfg: HybridConfig = HybridConfig(), component: str = "power"
) -> DataFrame:
    grid = FB.fb_transform(wf, fb).select("call_id", "frame_idx", "time", "mags")
    return track_calls(FR.pack_calls(grid), FB.fb_axis(fb), cfg, component)


STFT_HYBRID = HybridConfig(radius=1.0, bin_radius=2)


def track_hybrid_stft(
    wf: DataFrame, mr: FR.MultiResConfig, cfg: HybridConfig = STFT_HYBRID, strategy: str = "arrow"
) -> DataFrame:
    """Two resolutions: paths follow the coarse spectrum, evidence and refinement use the fine one."""
    both = FR.multires_stft(wf, mr, strategy)
    coarse_axis, _ = FR.stft_axis(mr.sr, mr.coarse_n_fft, mr.fmin, mr.fmax)
    fine_axis, _ = FR.stft_axis(mr.sr, mr.fine_n_fft, mr.fmin, mr.fmax)
    return track_calls(both, fine_axis, cfg, "power", "coarse", coarse_axis, "fine")
