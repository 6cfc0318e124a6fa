"""Contour editing, markers, alignment, trimming and traced contours."""

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
from .smooth import marker_bounds


def dedupe_times(corr: DataFrame) -> DataFrame:
    """Average the correction points that share a time."""
    return corr.groupBy("call_id", "time").agg(F.avg("freq").alias("freq"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _spline(times: pd.Series, px: pd.Series, py: pd.Series) -> pd.Series:
    return pd.Series([not_a_knot(np.asarray(x, float), np.asarray(y, float), np.asarray(t, float)) for t, x, y in zip(times, px, py)])


def not_a_knot(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline with continuous third derivative at the second and last-but-one knot (>= 4 knots).

    The end conditions are put into the second and last-but-one row, so the inner curvatures are a tridiagonal and
    diagonally dominant system, solved by one elimination forward and one substitution back.
    """
    n = len(x)
    h = np.diff(x)
    low, diagonal, up = h[:-1].copy(), 2.0 * (h[:-1] + h[1:]), h[1:].copy()
    p, q = h[0], h[1]
    diagonal[0], up[0] = (p + q) * (p + 2.0 * q) / q, (q * q - p * p) / q
    p, q = h[-2], h[-1]
    diagonal[-1], low[-1] = (p + q) * (2.0 * p + q) / p, (p * p - q * q) / p
    right = 6.0 * np.diff(np.diff(y) / h)
    for i in range(1, n - 2):
        share = low[i] / diagonal[i - 1]
        diagonal[i] -= share * up[i - 1]
        right[i] -= share * right[i - 1]
    s = np.zeros(n)
    s[n - 2] = right[-1] / diagonal[-1]
    for i in range(n - 4, -1, -1):
        s[i + 1] = (right[i] - up[i] * s[i + 2]) / diagonal[i]
    s[0] = ((h[0] + h[1]) * s[1] - h[0] * s[2]) / h[1]
    s[-1] = ((h[-2] + h[-1]) * s[-2] - h[-1] * s[-3]) / h[-2]
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    u, v = x[k + 1] - at, at - x[k]
    return (
        (s[k] * u**3 + s[k + 1] * v**3) / (6.0 * h[k])
        + (y[k] / h[k] - s[k] * h[k] / 6.0) * u
        + (y[k + 1] / h[k] - s[k + 1] * h[k] / 6.0) * v
    )


def apply_corrections(contour: DataFrame, corr: DataFrame, fmax: float, bounds: DataFrame | None = None) -> DataFrame:
    """Contour with hand-placed points applied.

    One point sets a constant within half a second; distinct times 2-3 interpolate linearly and 4 or more by
    a cubic spline, only inside the span of the points; the result is limited to [0, fmax].  Only calls with
    four or more points pass through the Arrow spline.
    """
    base = zero_outside(contour, bounds) if bounds is not None else contour
    raw = corr.groupBy("call_id").agg(F.count(F.lit(1)).alias("_raw"))
    points = (
        R.pack(dedupe_times(corr), ["time", "freq"], order="time")
        .select("call_id", F.col("time").alias("_px"), F.col("freq").alias("_py"))
        .join(raw, "call_id")
    )
    calls = R.pack(base, ["time", "frequency"]).join(points, "call_id", "left")
    t, f, px, py = (F.col(c) for c in ("time", "frequency", "_px", "_py"))
    first, last = F.get(px, F.lit(0)), F.element_at(px, -1)
    inside = lambda v: (v >= first) & (v <= last)
    one = F.zip_with(t, f, lambda a, b: F.when(F.abs(a - first) < 0.5, F.get(py, F.lit(0))).otherwise(b))
    linear = F.zip_with(t, f, lambda a, b: F.when(inside(a), R.interp(a, px, py)).otherwise(b))

    few = calls.filter(px.isNull() | (F.size(px) < 4)).withColumn(
        "frequency",
        F.when(px.isNull(), f)
        .when((F.col("_raw") == 1), one)
        .when(F.size(px) >= 2, linear)
        .otherwise(f),
    )
    many = (
        calls.filter(F.size(px) >= 4)
        .withColumn("_s", _spline(t, px, py))
        .withColumn(
            "frequency",
            F.transform(
                F.arrays_zip(t.alias("t"), f.alias("f"), F.col("_s").alias("s")),
                lambda z: F.when(inside(z["t"]), z["s"]).otherwise(z["f"]),
            ),
        )
    )
    cols = ["call_id", "frame_idx", "time", "frequency"]
    edited = few.select(*cols).unionByName(many.select(*cols))
    limited = F.transform("frequency", lambda v: A.clip(v, 0.0, fmax)).alias("frequency")
    return R.unpack(edited.select("call_id", "frame_idx", "time", limited), ["frame_idx", "time", "frequency"])


def zero_outside(contour: DataFrame, bounds: DataFrame) -> DataFrame:
    """Zero frequencies outside [start_s, end_s]; reversed bounds are swapped, calls without bounds stay."""
    lo, hi = F.least("start_s", "end_s"), F.greatest("start_s", "end_s")
    both = F.col("start_s").isNotNull() & F.col("end_s").isNotNull()
    out = both & ((F.col("time") < lo) | (F.col("time") > hi))
    return (
        contour.join(bounds, "call_id", "left")
        .withColumn("frequency", F.when(F.coalesce(out, F.lit(False)), F.lit(0.0)).otherwise(F.col("frequency")))
        .select(*contour.columns)
    )


def assign_markers(contour: DataFrame, bounds: DataFrame) -> DataFrame:
    """One-hot ``start_point``/``end_point``: frame nearest to the given time, else first/last voiced frame."""
    c = contour.drop("start_point", "end_point")
    j = c.join(bounds.select("call_id", "start_s", "end_s"), "call_id", "left")
    near = lambda b: F.min_by("frame_idx", F.when(F.col(b).isNotNull(), F.struct(F.abs(F.col("time") - F.col(b)), F.col("frame_idx"))))
    voiced = F.when(F.col("frequency") > 0, F.col("frame_idx"))
    marks = j.groupBy("call_id").agg(
        F.coalesce(near("start_s"), F.min(voiced)).alias("_s"), F.coalesce(near("end_s"), F.max(voiced)).alias("_e")
    )
    hot = lambda m: F.coalesce((F.col("frame_idx") == F.col(m)).cast("int"), F.lit(0))
    return c.join(marks, "call_id").select(*c.columns, hot("_s").alias("start_point"), hot("_e").alias("end_point"))


FLAGS = ("overlapping", "bad", "awesome")


def set_flags(contour: DataFrame, flags: DataFrame) -> DataFrame:
    """Per-call quality flags on every row; calls without an entry get 0."""
    c = contour.drop(*FLAGS)
    return c.join(flags.select("call_id", *FLAGS), "call_id", "left").select(
        *c.columns, *[F.coalesce(F.col(f).cast("int"), F.lit(0)).alias(f) for f in FLAGS]
    )


def read_flags(contour: DataFrame) -> DataFrame:
    """Flags of a call, read from its first row; absent columns count as 0."""
    have = [f for f in FLAGS if f in contour.columns]
    first = contour.groupBy("call_id").agg(
        F.min("frame_idx").alias("_n"), *[F.min_by(f, "frame_idx").cast("int").alias(f) for f in have]
    )
    return first.select("call_id", *[F.col(f) if f in have else F.lit(0).alias(f) for f in FLAGS])


def realign(contour: DataFrame) -> DataFrame:
    """Frames from the first start to the last end marker with time restarted; marker columns dropped.

    Calls lacking either marker are left out.
    """
    b = marker_bounds(contour).filter(F.col("first_start").isNotNull() & F.col("last_end").isNotNull())
    span = b.select(
        "call_id", F.least("first_start", "last_end").alias("_lo"), F.greatest("first_start", "last_end").alias("_hi")
    )
    cut = contour.join(span, "call_id").filter(F.col("frame_idx").between(F.col("_lo"), F.col("_hi")))
    t0 = cut.groupBy("call_id").agg(F.min_by("time", "frame_idx").alias("_t0"))
    kept = [c for c in contour.columns if c not in ("start_point", "end_point")]
    return cut.join(t0, "call_id").withColumn("time", F.col("time") - F.col("_t0")).select(*kept)


def _mark_times(contour: DataFrame) -> DataFrame:
    """Times and frames of the first start and the first end marker."""
    at = lambda flag, c: F.min_by(c, F.when(F.col(flag) == 1, F.col("frame_idx")))
    return contour.groupBy("call_id").agg(
        at("start_point", "time").alias("_s"),
        at("end_point", "time").alias("_e"),
        at("start_point", "frame_idx").alias("_sf"),
        at("end_point", "frame_idx").alias("_ef"),
    )


def trim(contour: DataFrame, wf: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Contour and samples between the first start and the first end marker; unmarked calls are left out."""
    m = _mark_times(contour).filter(F.col("_s").isNotNull() & F.col("_e").isNotNull())
    span = m.select("call_id", F.least("_s", "_e").alias("_lo"), F.greatest("_s", "_e").alias("_hi"))
    rows = contour.join(span, "call_id").filter(F.col("time").between(F.col("_lo"), F.col("_hi")))
    rows = rows.withColumn("time", F.col("time") - F.col("_lo")).select(*contour.columns)
    if wf is None:
        return rows, None
    a = F.greatest((F.col("_lo") * F.col("sr")).cast("int"), F.lit(0))
    b = F.least((F.col("_hi") * F.col("sr")).cast("int"), F.size("samples"))
    part = F.slice("samples", a + 1, F.greatest(b - a, F.lit(0)))
    return rows, wf.join(span, "call_id").withColumn("samples", part).select(*wf.columns)


def trim_stretch(contour: DataFrame, durations: DataFrame, target: float | None = 2.5) -> tuple[DataFrame, DataFrame]:
    """Contour between markers (end frame included; whole call when unmarked), stretched to ``target`` seconds.

    ``durations`` is (call_id, duration, sr).  Returns the rows and one summary row per call.
    """
    m = _mark_times(contour).join(durations, "call_id")
    marked = F.col("_s").isNotNull() & F.col("_e").isNotNull()
    n_all = (F.col("duration") * F.col("sr")).cast("bigint")
    lo = F.when(marked, (F.col("_s") * F.col("sr")).cast("bigint")).otherwise(F.lit(0))
    hi = F.when(marked, (F.col("_e") * F.col("sr")).cast("bigint")).otherwise(n_all)
    length = F.greatest(F.least(hi, n_all) - F.least(lo, n_all), F.lit(0)) / F.col("sr")
    stretched = F.lit(target is not None) & (length < F.lit(target or 0.0))
    info = m.select(
        "call_id",
        F.when(marked, F.col("_s")).otherwise(0.0).alias("start_s"),
        F.when(marked, F.col("_e")).otherwise(F.col("duration")).alias("end_s"),
        F.when(marked, F.col("_sf")).alias("_sf"),
        F.when(marked, F.col("_ef")).alias("_ef"),
        stretched.alias("stretched"),
        F.when(stretched, length / F.lit(target or 1.0)).otherwise(1.0).alias("rate"),
    )
    rows = contour.join(info, "call_id").filter(
        F.col("_sf").isNull() | F.col("frame_idx").between(F.col("_sf"), F.col("_ef"))
    )
    moved = F.when(
        F.col("stretched"), (F.col("time") - F.col("start_s")) / F.when(F.col("rate") > 0, F.col("rate"))
    ).otherwise(F.col("time") - F.col("start_s"))
    return rows.withColumn("time", moved).select(*contour.columns), info.select(
        "call_id", "start_s", "end_s", "stretched", "rate"
    )


@dataclass(frozen=True)
class TraceConfig:
    """Canvas and pitch range of a hand-drawn trace."""

    f0_min: float = 10.0
    f0_max: float = 30.0
    scale: str = "linear"
    width: int = 1600
    height: int = 790
    coverage: float = 0.55
    kernel: int = 5

    def __post_init__(self) -> None:
        if self.f0_min <= 0 or self.f0_max <= self.f0_min:
            raise ValueError("the frequency band is empty or not positive")
        if self.scale not in ("linear", "log"):
            raise ValueError("unknown axis, use 'linear' or 'log'")


def trace_to_contour(pixels: DataFrame, cfg: TraceConfig) -> DataFrame:
    """Ink pixels (trace_id, x, y) to one F0 value per canvas column.

    Median row per column, linear fill of empty columns, median-5 with held edges, row inverted to pitch.
    Traces with under two inked columns or too little coverage are left out.
    """
    cols = pixels.groupBy("trace_id", "x").agg(F.percentile(F.col("y").cast("double"), F.lit(0.5)).alias("cy"))
    packed = R.pack(cols, ["x", "cy"], order="x", key="trace_id")
    span = F.element_at("x", -1) - F.get("x", F.lit(0)) + 1.0
    usable = packed.filter((F.size("x") >= 2) & (span / cfg.width >= cfg.coverage))
    grid = F.sequence(F.lit(0), F.lit(cfg.width - 1))
    filled = R.interp_all(grid, F.col("x"), F.col("cy"))
    smooth = R.median_filter(filled, cfg.kernel, "nearest")

    def pitch(y: Column) -> Column:
        pos = A.clip(1.0 - y / (cfg.height - 1.0), 0.0, 1.0)
        if cfg.scale == "log":
            return F.lit(cfg.f0_min) * F.pow(F.lit(cfg.f0_max / cfg.f0_min), pos)
        return F.lit(cfg.f0_min) + pos * (cfg.f0_max - cfg.f0_min)

    seen = lambda: F.transform(grid, lambda i: F.array_contains("x", i))
    out = usable.select("trace_id", F.transform(smooth, pitch).alias("f0"), seen().alias("observed"))
    return out.select("trace_id", F.posexplode(F.arrays_zip("f0", "observed")).alias("col", "z")).select(
        "trace_id", "col", (F.col("col") / (cfg.width - 1.0)).alias("position"), "z.f0", "z.observed"
    )


def trace_to_duration(trace: DataFrame, durations: DataFrame, dt: float) -> DataFrame:
    """Stretch a normalised trace over a call: (trace_id, frame_idx, time, frequency, f0_hz, confidence, ...)."""
    if dt <= 0:
        raise ValueError("the frame resolution must be positive")
    packed = R.pack(
        trace.withColumn("observed", F.col("observed").cast("double")), ["position", "f0", "observed"], order="col", key="trace_id"
    )
    dur = F.col("duration")
    n = F.ceil(dur / dt - 1e-9).cast("int")
    times = F.when(n >= 2, F.transform(A.seq(n), lambda i: i * F.lit(dt))).otherwise(
        F.array(F.lit(0.0), F.greatest(dur - 1e-9, F.lit(0.0)))
    )
    calls = packed.join(durations.filter(dur > 0), "trace_id").withColumn("time", times)
    norm = F.transform("time", lambda v: A.clip(v / dur, 0.0, 1.0))
    calls = calls.select(
        "trace_id",
        "time",
        R.interp_all(norm, F.col("position"), F.col("f0")).alias("f0_hz"),
        R.interp_all(norm, F.col("position"), F.col("observed")).alias("c"),
        F.size("time").alias("n"),
    )
    rows = calls.select("trace_id", "n", F.posexplode(F.arrays_zip("time", "f0_hz", "c")).alias("frame_idx", "z"))
    return rows.select(
        "trace_id",
        "frame_idx",
        F.col("z.time").alias("time"),
        X.f0_to_h1(F.col("z.f0_hz")).alias("frequency"),
        F.col("z.f0_hz").alias("f0_hz"),
        A.clip(F.col("z.c"), 0.0, 1.0).alias("confidence"),
        (F.col("frame_idx") == 0).cast("int").alias("start_point"),
        (F.col("frame_idx") == F.col("n") - 1).cast("int").alias("end_point"),
        F.lit("photo_drawing").alias("algorithm"),
        F.lit("f1").alias("frequency_role"),
    )


def harmonic_guides(versions: DataFrame, k_max: int, fmax: float) -> DataFrame:
    """Implied F0 and its harmonics up to the display limit, per contour version."""
    voiced = versions.filter(X.voiced("frequency")).withColumn("f0", X.h1_to_f0("frequency"))
    return X.harmonics(voiced, k_max, fmax).select("call_id", "version", "frame_idx", "time", "f0", "k", "harmonic_hz")
