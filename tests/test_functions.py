import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourlake.functions import arrays as A
from contourlake.functions import exprs as X
from contourlake.functions import scales as S
from contourlake.functions import series as R
from contourlake.sources import stores as SO


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("scale", S.SCALES)
def test_scale_round_trip(spark, scale):
    hz = spark.createDataFrame([(float(f),) for f in (1, 5, 20, 100.5, 440, 999, 7999)], "f double")
    back = hz.select("f", S.aud_to_hz(S.hz_to_aud("f", scale), scale).alias("b"))
    warped = hz.select("f", S.aud_to_hz_mod(S.hz_to_aud_mod("f", 20.0, 500.0, scale), 20.0, 500.0, scale).alias("b"))
    for df in (back, warped):
        for r in df.collect():
            assert r["b"] == pytest.approx(r["f"], rel=1e-9)


def test_scale_errors(spark):
    with pytest.raises(ValueError):
        S.hz_to_aud("f", "bark")
    with pytest.raises(ValueError):
        S.hz_to_aud_mod("f", 0.0, 10.0)
    with pytest.raises(ValueError):
        S.aud_axis(spark, 10.0, 5.0, 4)
    with pytest.raises(Exception):
        one(spark, S.fc_to_bw(F.lit(-1.0), "erb"))


def test_axis_end_points_and_linear_case(spark):
    rows = S.aud_axis(spark, 20.0, 400.0, 16, "mel").orderBy("channel").collect()
    assert rows[0]["freq_hz"] == 20.0 and rows[-1]["freq_hz"] == 400.0
    assert np.allclose([r["freq_hz"] for r in rows], S.axis_values(20.0, 400.0, 16, "mel"))
    flat = S.aud_axis(spark, 100.0, 100.0, 5, "mel", 1000).orderBy("channel").collect()
    assert [r["freq_hz"] for r in flat] == [0.0, 125.0, 250.0, 375.0, 500.0]


def test_hann_sums_to_one_and_is_centred(spark):
    w = [r["w"] for r in S.hann(spark, 5, padto=9).orderBy("n").collect()]
    assert sum(w) == pytest.approx(1.0)
    assert np.argmax(w) == 4 and w[:2] == [0.0, 0.0]


def test_percentile_matches_numpy(spark):
    data = [5.0, 1.0, 9.0, 2.5, 7.0, 3.0]
    for p in (0.0, 0.25, 0.5, 0.75, 0.9, 1.0):
        assert one(spark, A.percentile(A.dlit(data), p)) == pytest.approx(np.percentile(data, 100 * p))
    assert one(spark, A.median(A.dlit([]))) is None


def test_first_index_wins_ties(spark):
    assert one(spark, A.first_max(A.dlit([1.0, 4.0, 4.0]))) == 1
    assert one(spark, A.first_min(A.dlit([3.0, 1.0, 1.0]))) == 1


def test_linear_map_strategies_agree(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(4, 6)) * (rng.random((4, 6)) < 0.5)
    frames = rng.normal(size=(5, 6)).tolist()
    df = spark.createDataFrame([(frames,)], "f array<array<double>>")
    for strategy in ("expr", "arrow"):
        got = df.select(A.linear_map(F.col("f"), m, strategy).alias("v")).first()["v"]
        assert np.allclose(got, np.array(frames) @ m.T, atol=1e-12)


def test_median_edges(spark):
    # mirror repeats the edge sample: index 0 sees [5, 1 | 1, 5, 2], whose median is 2
    assert one(spark, R.median_filter(A.dlit([1.0, 5.0, 2.0, 8.0, 3.0]), 5)) == [2.0, 2.0, 3.0, 3.0, 3.0]
    assert one(spark, R.median_filter(A.dlit([1.0, 5.0, 2.0, 8.0, 3.0]), 3, "nearest")) == [1.0, 2.0, 5.0, 3.0, 3.0]


def test_voiced_run_median_holds_run_edges(spark):
    assert one(spark, R.voiced_run_median(A.dlit([0, 5, 9, 5, 0, 7]), 3)) == [0, 5, 5, 5, 0, 7]
    assert one(spark, R.voiced_run_median(A.dlit([0, 0]), 3)) == [0, 0]
    assert one(spark, R.voiced_run_median(A.dlit([4, 6]), 3)) == [4, 6]


def test_gated_median_needs_enough_frames(spark):
    f, c = A.dlit([1.0, 9.0, 2.0, 3.0]), A.dlit([0.9, 0.9, 0.9, 0.1])
    assert one(spark, R.gated_median(f, c, 3, F.lit(0.5))) == [1.0, 9.0, 2.0, 3.0]
    f, c = A.dlit([1.0, 9.0, 2.0, 3.0, 50.0]), A.dlit([0.9, 0.9, 0.9, 0.9, 0.1])
    # compacted 1, 9, 2, 3 with mirrored ends; an even kernel of 2 acts as 3
    assert one(spark, R.gated_median(f, c, 2, F.lit(0.5))) == [1.0, 2.0, 3.0, 3.0, 50.0]


def test_quad_offset_and_margin(spark):
    assert one(spark, X.quad_offset(F.lit(1.0), F.lit(1.0), F.lit(1.0))) == 0.0
    assert one(spark, X.quad_offset(F.lit(1.0), F.lit(3.0), F.lit(2.0))) == pytest.approx(1 / 6)
    assert one(spark, X.sigmoid_margin(F.lit(100.0), F.lit(0.0))) == pytest.approx(1 / (1 + math.exp(-12)))


def test_time_frame_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (99.0,), (-3.0,)], "t double")
    got = [r[0] for r in df.select(X.time_frame("t", 1, 1.0, 10)).collect()]
    assert got == [0, 2, 2, 9, 0]


def test_highpass_gain(spark):
    f = spark.createDataFrame([(0.0,), (10.0,), (400.0,)], "f double")
    g = [r[0] for r in f.select(X.highpass_gain("f", 10.0, 1000.0)).collect()]
    assert g[0] == 0.0 and g[1] == pytest.approx(0.5) and g[2] == pytest.approx(1.0, abs=1e-9)
    assert one(spark, X.highpass_gain(F.lit(5.0), 0.0, 1000.0)) == 1.0


def test_interp_and_zscore(spark):
    xp, fp = A.dlit([0.0, 1.0, 3.0]), A.dlit([0.0, 10.0, 30.0])
    t = [-1.0, 0.0, 0.5, 1.0, 2.0, 3.0, 4.0]
    assert one(spark, R.interp_all(A.dlit(t), xp, fp)) == list(np.interp(t, [0, 1, 3], [0, 10, 30]))
    zero = F.lit(0.0)
    assert one(spark, R.interp_all(A.dlit([-1.0, 4.0]), xp, fp, zero, zero)) == [0.0, 0.0]
    assert one(spark, R.zscore(A.dlit([2.0, 2.0]))) == [0.0, 0.0]
    assert np.allclose(one(spark, R.zscore(A.dlit([1.0, 2.0, 4.0]))), (np.array([1, 2, 4]) - 7 / 3) / np.std([1, 2, 4]))


def test_names(spark):
    v = lambda s: one(spark, SO.norm_version(F.lit(s)))
    assert v("  Hybrid-STFT ") == "hybrid_stft" and v("   ") == "peak" and v(None) == "peak"
    assert one(spark, SO.store_name("STFT ", 750.0)) == "stft_750"
    assert one(spark, SO.store_name("stft", 62.5)) == "stft_62p5"


def _runs(values, k):
    """Median of ``k`` inside each positive run, the run's edges held."""
    out, r = list(values), k // 2
    for i, x in enumerate(values):
        if x > 0:
            lo = hi = i
            while lo > 0 and values[lo - 1] > 0:
                lo -= 1
            while hi + 1 < len(values) and values[hi + 1] > 0:
                hi += 1
            out[i] = sorted(values[min(max(j, lo), hi)] for j in range(i - r, i + r + 1))[r]
    return out


def test_voiced_run_median_equals_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(rng.integers(0, 4, n) * 1.5).tolist() for n in (0, 1, 2, 7, 40, 200)]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<double>")
    got = got.orderBy("i").select(*[R.voiced_run_median(F.col("v"), k).alias(f"k{k}") for k in (3, 5)]).collect()
    assert [(r["k3"], r["k5"]) for r in got] == [(_runs(v, 3), _runs(v, 5)) for v in rows]


def test_gated_median_equals_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.random(n).tolist(), rng.random(n).round(1).tolist()) for i, n in enumerate((0, 1, 6, 60, 300))]
    df = spark.createDataFrame(rows, "i int, f array<double>, c array<double>").orderBy("i")
    for (_, f, c), row in zip(rows, df.select(R.gated_median(F.col("f"), F.col("c"), 5, F.lit(0.5)).alias("g")).collect()):
        at = [i for i, x in enumerate(c) if x > 0.5]
        want = list(f)
        if len(at) > 5:
            chosen = np.pad([f[i] for i in at], 2, mode="symmetric")
            for j, i in enumerate(at):
                want[i] = float(np.median(chosen[j : j + 5]))
        assert row["g"] == want
