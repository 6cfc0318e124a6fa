"""Expressions on one call's arrays: median filters, interpolation, differences, gating.

Every function takes and returns array columns, so a chain of them costs one grouping by call.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A


def pack(df: DataFrame, cols: list[str], order: str = "frame_idx", key: str = "call_id") -> DataFrame:
    """One row per call with every column as an array in ``order``; a call is bounded by its source."""
    packed = F.sort_array(F.collect_list(F.struct(order, *[c for c in cols if c != order])))
    pick = lambda c: F.transform("p", lambda s: s[c]).alias(c)
    return df.groupBy(key).agg(packed.alias("p")).select(key, *[pick(c) for c in dict.fromkeys([order, *cols])])


def unpack(df: DataFrame, arrays: list[str], keep: list[str] = ("call_id",)) -> DataFrame:
    """Arrays of equal length back to rows."""
    return df.select(*keep, F.explode(F.arrays_zip(*arrays)).alias("z")).select(*keep, "z.*")


def _window_median(v: Column, k: int, index) -> Column:
    """Middle element of ``k`` neighbours; ``index`` maps a position outside the array back inside."""
    before = k // 2

    def at(i: Column) -> Column:
        near = F.transform(F.sequence(i - before, i + (k - before - 1)), lambda j: F.get(v, index(j, F.size(v))))
        return F.get(F.array_sort(near), F.lit(k // 2))

    return F.transform(A.seq(F.size(v)), at)


def median_filter(a: Column, k: int, edge: str = "mirror") -> Column:
    """Median of ``k`` neighbours: ``mirror`` repeats the edge sample and reflects, ``nearest`` holds it."""

    def mirror(j: Column, n: Column) -> Column:
        m = F.pmod(j, n * 2)
        return F.when(m < n, m).otherwise(n * 2 - 1 - m).cast("int")

    def nearest(j: Column, n: Column) -> Column:
        return F.greatest(F.least(j, n - 1), F.lit(0)).cast("int")

    if k <= 1:
        return a
    return A.let(a, lambda v: _window_median(v, k, {"mirror": mirror, "nearest": nearest}[edge]))


def median_positive(a: Column, k: int, edge: str = "mirror") -> Column:
    """Median applied to positive values; zeros stay."""
    if k <= 1:
        return a
    return A.let(
        a, lambda v: F.zip_with(v, median_filter(v, k, edge), lambda x, m: F.when(x > 0, m).otherwise(x))
    )


def _between(v: Column, starts: Column, ends: Column, piece: Callable[[Column, Column], Column]) -> Column:
    """``v`` with the stretches from ``starts`` to ``ends`` (ascending, apart) replaced by ``piece(start, ordinal)``.

    Pieces and the stretches between them are joined once, so no array grows step by step.
    """

    def part(at: Column, j: Column) -> Column:
        end = F.get(ends, j)
        until = F.coalesce(F.get(starts, j + 1), F.size(v))
        return F.concat(piece(at, j), F.slice(v, end + 2, until - end - 1))

    head = F.slice(v, F.lit(1), F.coalesce(F.get(starts, F.lit(0)), F.size(v)))
    return F.concat(head, F.flatten(F.transform(starts, part)))


def confidence_threshold(conf: Column) -> Column:
    """Lower quartile of the positive confidences."""
    return A.percentile(F.filter(conf, lambda c: c > 0), 0.25)


def gated_median(freq: Column, conf: Column, k: int, threshold: Column | None = None) -> Column:
    """Median over the compacted sequence of confident frames; others stay.

    Nothing changes when no more than ``k`` frames qualify; an even ``k`` becomes odd.
    """
    if k <= 1:
        return freq
    k += k % 2 == 0
    thr = confidence_threshold(conf) if threshold is None else threshold

    def body(s: Column) -> Column:
        f, c, t = s["f"], s["c"], s["t"]
        chosen = F.filter(A.seq(F.size(f)), lambda i: F.get(c, i) > t)

        def apply(w: Column) -> Column:
            med = median_filter(F.transform(w, lambda i: F.get(f, i)), k)
            return F.when(F.size(w) > k, A.let(F.struct(w.alias("w"), med.alias("m")), replaced)).otherwise(f)

        def replaced(pair: Column) -> Column:
            return _between(f, pair["w"], pair["w"], lambda at, j: F.array(F.coalesce(F.get(pair["m"], j), F.get(f, at))))

        return A.let(chosen, apply)

    return A.let(F.struct(freq.alias("f"), conf.alias("c"), thr.alias("t")), body)


def energy_gate(freq: Column, peak: Column, fraction: float) -> Column:
    """Zero frames whose peak is below a fraction of the call's strongest peak."""
    return A.let(
        F.struct(freq.alias("f"), peak.alias("p"), F.array_max(peak).alias("top")),
        lambda s: F.when(
            s["top"] > 0,
            F.zip_with(s["f"], s["p"], lambda f, p: F.when(p < s["top"] * fraction, F.lit(0.0)).otherwise(f)),
        ).otherwise(s["f"]),
    )


def voiced_run_median(a: Column, k: int) -> Column:
    """Median inside each run of positive values, edges of the run held; zeros stay.

    The bounds of all runs are found first and each run is filtered alone: time is linear in the frames.
    """
    if k <= 1:
        return a
    k += k % 2 == 0

    def body(v: Column) -> Column:
        inside = lambda i: (i >= 0) & (i < F.size(v)) & ~F.coalesce(F.get(v, i) <= 0, F.lit(False))
        bound = lambda side: F.filter(A.seq(F.size(v)), lambda i: inside(i) & ~inside(i + side))

        def smoothed(s: Column) -> Column:
            def one(at: Column, j: Column) -> Column:
                return A.let(F.slice(v, at + 1, F.get(s["e"], j) - at + 1), lambda run: median_positive(run, k, "nearest"))

            return _between(v, s["s"], s["e"], one)

        return A.let(F.struct(bound(-1).alias("s"), bound(1).alias("e")), smoothed)

    return A.let(a, body)


def interp(x: Column, xp: Column, fp: Column, left: Column | None = None, right: Column | None = None) -> Column:
    """Linear interpolation of one value on sorted arrays; outside: given values, else the end values."""
    n = F.size(xp)
    j = F.size(F.filter(xp, lambda v: v <= x))
    lo = F.greatest(j - 1, F.lit(0))
    hi = F.least(j, n - 1)
    x0, x1, f0, f1 = F.get(xp, lo), F.get(xp, hi), F.get(fp, lo), F.get(fp, hi)
    inside = F.when((x1 > x0) & (x > x0), f0 + (f1 - f0) * ((x - x0) / F.when(x1 > x0, x1 - x0))).otherwise(f0)
    out = inside
    if right is not None:
        out = F.when(x > F.get(xp, n - 1), right).otherwise(out)
    if left is not None:
        out = F.when(x < F.get(xp, F.lit(0)), left).otherwise(out)
    return F.when(n > 0, out)


def interp_all(targets: Column, xp: Column, fp: Column, left: Column | None = None, right: Column | None = None) -> Column:
    return A.let(
        F.struct(targets.alias("t"), xp.alias("x"), fp.alias("f")),
        lambda s: F.transform(s["t"], lambda x: interp(x, s["x"], s["f"], left, right)),
    )


def diff0(a: Column) -> Column:
    """First difference with a leading zero."""
    return A.let(a, lambda v: F.transform(v, lambda x, i: F.when(i == 0, F.lit(0.0)).otherwise(x - F.get(v, i - 1))))


def abs_steps(a: Column) -> Column:
    """Absolute frame-to-frame changes (one shorter than the input)."""
    return A.let(
        a,
        lambda v: F.transform(
            A.seq(F.greatest(F.size(v) - 1, F.lit(0))), lambda i: F.abs(F.get(v, i + 1) - F.get(v, i))
        ),
    )


def roughness(a: Column) -> Column:
    """Median absolute frame-to-frame change; 0 for a single frame."""
    return F.coalesce(A.median(abs_steps(a)), F.lit(0.0))


def zscore(a: Column) -> Column:
    def body(v: Column) -> Column:
        def spread(mean: Column) -> Column:
            sd = F.sqrt(A.array_mean(F.transform(v, lambda x: (x - mean) * (x - mean))))
            return A.let(
                sd, lambda s: F.transform(v, lambda x: F.when(s > 0, (x - mean) / F.when(s > 0, s)).otherwise(0.0))
            )

        return A.let(A.array_mean(v), spread)

    return A.let(a, body)
