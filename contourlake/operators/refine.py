"""Harmonic-salience refinement of a contour around its own bins.

Which channels a candidate's harmonics touch depends on the axis only, so it is a constant table
(bin -> harmonic slots).  A contour row meets exactly one frame per scale by an equi join on (call, frame);
the candidate search is an expression over that frame.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import exprs as X
from ..functions import scales as S
from ..functions import series as R
from . import smooth as SM
from .lookup import nearest_frame


@dataclass(frozen=True)
class RefineConfig:
    sr: float = 16000.0
    n_harmonics: int = 12
    neighbor_radius: int = 3
    bin_radius: int = 1
    harmonic_exp: float = 0.35
    power_exp: float = 1.0
    min_f0: float = 5.0
    median_kernel: int = 5
    subbin: bool = True
    edge_kernel: int = 0
    stride: int = 256


def _slots(axis: np.ndarray, bins_hz: np.ndarray, cfg: RefineConfig, scale: str | None) -> Column:
    """Array per bin of harmonic slots (first channel, width, weight)."""
    nyq = cfg.sr / 2.0
    warp = axis if scale is None else np.array([_aud(f, scale) for f in axis])

    def nearest(hz: float) -> int:
        x = hz if scale is None else _aud(hz, scale)
        r = int(np.clip(np.searchsorted(warp, x), 1, len(warp) - 1))
        return r if warp[r] - x < x - warp[r - 1] else r - 1

    rows = []
    for f0 in bins_hz:
        k_max = min(cfg.n_harmonics, int(nyq // max(f0, 1e-8))) if f0 > cfg.min_f0 else 0
        cells = []
        for k in range(1, k_max + 1):
            if k * f0 >= nyq:
                break
            c = nearest(k * f0)
            lo, hi = max(0, c - cfg.bin_radius), min(len(axis) - 1, c + cfg.bin_radius)
            cells.append({"a": lo, "n": hi - lo + 1, "w": float(k) ** -cfg.harmonic_exp})
        rows.append(cells)
    return A.constant(rows, "array<array<struct<a:int,n:int,w:double>>>")


def _aud(f: float, scale: str) -> float:
    """Scale value of a positive constant."""
    return {
        "erb": lambda: S.ERB_FACTOR * math.log1p(f * S.ERB_RATE),
        "mel": lambda: 1000.0 / S.MEL_LOG * math.log1p(f / S.MEL_CORNER),
        "log10": lambda: math.log10(max(f, 1.0)),
        "elelog": lambda: math.log10(f / S.ELE_A + S.ELE_K) / S.ELE_ALPHA,
    }[scale]()


def salience(frame: Column, slots: Column) -> Column:
    """Weighted band means at a candidate's harmonics over the frame mean."""
    return A.let(
        F.struct(frame.alias("f"), (A.array_mean(frame) + 1e-12).alias("m")),
        lambda s: F.aggregate(
            slots,
            F.lit(0.0),
            lambda acc, c: acc + c["w"] * (A.array_sum(F.slice(s["f"], c["a"] + 1, c["n"])) / c["n"]) / s["m"],
        ),
    )


def _refine(
    contour: DataFrame,
    grids: list[tuple[DataFrame, list[float]]],
    cfg: RefineConfig,
    scale: str | None,
    frame_of: str,
    top_open: bool,
) -> DataFrame:
    ref = np.asarray(grids[0][1], dtype=float)
    if len(ref) < 3:
        raise ValueError("refinement needs at least 3 channels")
    n = len(ref)
    warped = ref if scale is None else np.array([_aud(f, scale) for f in ref])
    rows = contour.withColumn("frequency_original", F.col("frequency")).withColumn("_f0", X.h1_to_f0("frequency"))
    rows = SM.edge_radius(rows, cfg.edge_kernel, cfg.stride, cfg.neighbor_radius)
    slot_tables = []
    for i, (grid, axis) in enumerate(grids):
        slot_tables.append(_slots(np.asarray(axis, dtype=float), ref, cfg, scale))
        power = F.transform("mags", lambda m: F.pow(m, F.lit(float(cfg.power_exp)))) if cfg.power_exp != 1.0 else F.col("mags")
        keyed = grid.select("call_id", F.col("frame_idx").alias(f"_k{i}"), power.alias(f"_p{i}"))
        if frame_of == "nearest":
            rows = nearest_frame(rows, grid, f"_k{i}")
        else:
            count = grid.groupBy("call_id").agg((F.max("frame_idx") + 1).alias("_n"))
            rows = rows.join(count, "call_id").withColumn(
                f"_k{i}", X.time_frame("time", cfg.stride, cfg.sr, F.col("_n"))
            ).drop("_n")
        rows = rows.join(keyed, ["call_id", f"_k{i}"])
    f0 = F.col("_f0")
    target = f0 if scale is None else S.hz_to_aud(f0, scale)
    axis_col = A.dlit(warped)
    base = F.array_min(F.transform(axis_col, lambda v, i: F.struct(F.abs(v - target).alias("d"), i.alias("i"))))["i"]
    last = n - 2 if top_open else n - 1

    def search(s: Column) -> Column:
        lo, hi = F.greatest(s["b"] - s["r"], F.lit(1)), F.least(s["b"] + s["r"], F.lit(last))
        bins = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.expr("cast(array() as array<int>)"))
        usable = F.filter(bins, lambda b: F.size(F.get(slot_tables[0], b)) > 0)

        def scored(b: Column) -> Column:
            total = None
            for i, table in enumerate(slot_tables):
                part = salience(s[f"p{i}"], F.get(table, b))
                total = part if total is None else total + part
            return total

        return A.let(
            usable,
            lambda bs: A.let(F.transform(bs, scored), lambda sc: F.when(F.size(bs) > 0, place(bs, sc))),
        )

    def place(bs: Column, sc: Column) -> Column:
        def at(i: Column) -> Column:
            inner = F.lit(cfg.subbin) & (i > 0) & (i < F.size(sc) - 1)
            delta = X.quad_offset(F.get(sc, i - 1), F.get(sc, i), F.get(sc, i + 1), 1.0)
            b = F.get(bs, i).cast("double")
            moved = F.when(inner, A.clip(b + delta, 1.0, float(last))).otherwise(b)
            return A.let(
                moved,
                lambda x: A.let(
                    F.floor(x).cast("int"),
                    lambda j: F.get(axis_col, j)
                    + (F.get(axis_col, F.least(j + 1, F.lit(n - 1))) - F.get(axis_col, j)) * (x - j),
                ),
            )

        return A.let(A.first_max(sc), at)

    state = F.struct(
        base.alias("b"), F.col("radius").alias("r"), *[F.col(f"_p{i}").alias(f"p{i}") for i in range(len(grids))]
    )
    found = A.let(state, search)
    hz = found if scale is None else S.aud_to_hz(found, scale)
    usable = X.finite(f0) & (f0 > cfg.min_f0)
    refined = F.when(usable, F.coalesce(hz, f0)).when(f0 <= 0, F.lit(0.0)).otherwise(f0)
    keep = [c for c in contour.columns if c != "frequency"]
    out = rows.select(*keep, "frequency_original", refined.alias("_f0"))
    if cfg.median_kernel > 1:
        others = [c for c in keep if c not in ("call_id", "frame_idx")]
        packed = R.pack(out, [*others, "frequency_original", "_f0"])
        packed = packed.withColumn("_f0", R.voiced_run_median(F.col("_f0"), cfg.median_kernel))
        out = R.unpack(packed, ["frame_idx", *others, "frequency_original", "_f0"])
    return out.select(*keep, X.f0_to_h1("_f0").alias("frequency"), "frequency_original")


def refine_aud(
    contour: DataFrame,
    grids: list[tuple[DataFrame, list[float]]],
    cfg: RefineConfig = RefineConfig(),
    scale: str = "elelog",
    frame_of: str = "rint",
) -> DataFrame:
    """Refinement on auditory bins; ``grids`` are (dense frames, ascending axis) per kernel size.

    The output keeps the input as ``frequency_original``.
    """
    return _refine(contour, grids, cfg, scale, frame_of, True)


def refine_stft(
    contour: DataFrame, grids: list[tuple[DataFrame, list[float]]], cfg: RefineConfig = RefineConfig()
) -> DataFrame:
    """The same on linear spectrum bins over several window lengths."""
    return _refine(contour, grids, cfg, None, "rint", False)
