import numpy as np
import pytest
from pyspark.sql import functions as F

from contourlake.functions import arrays as A
from contourlake.functions import ranks as RK
from contourlake.operators import cluster as K
from contourlake.operators import edit as E
from contourlake.operators import filterbank as FB
from contourlake.operators import frames as FR
from contourlake.operators import hybrid as H
from contourlake.operators import lookup as L
from contourlake.operators import mask as MK
from contourlake.operators import stats as ST
from contourlake.operators import track as TR
from contourlake.plans import jobs as J
from contourlake.sources import stores as SO


def waves(spark, calls, sr=1000):
    rows = [(k, sr, [float(v) for v in x]) for k, x in calls.items()]
    return spark.createDataFrame(rows, "call_id bigint, sr int, samples array<double>")


def values(df, col, order="frame_idx"):
    return [r[col] for r in df.orderBy("call_id", order).collect()]


# ------------------------------------------------------------------ transforms


def test_pure_tone_lands_in_its_bin(spark):
    n = np.arange(640)
    wf = waves(spark, {1: np.cos(2 * np.pi * 5 * n / 64)})
    for strategy in ("arrow", "expr"):
        fr = FR.stft(wf, 1000, 64, 32, strategy=strategy).orderBy("frame_idx").collect()
        assert all(int(np.argmax(r["mags"])) == 5 for r in fr[1:-1])


def test_strategies_agree(spark):
    rng = np.random.default_rng(0)
    wf = waves(spark, {1: rng.normal(size=500), 2: rng.normal(size=333)})
    for pad in ("zero", "reflect"):
        a = FR.stft(wf, 1000, 64, 16, 48, 30.0, 300.0, pad, strategy="arrow").orderBy("call_id", "frame_idx").collect()
        b = FR.stft(wf, 1000, 64, 16, 48, 30.0, 300.0, pad, strategy="expr").orderBy("call_id", "frame_idx").collect()
        assert len(a) == len(b)
        assert np.allclose([r["mags"] for r in a], [r["mags"] for r in b], atol=1e-9)
    # odd kernel, a stride that does not divide the length
    cfg = FB.FilterbankConfig(kernel_size=33, num_channels=5, stride=7, f_min=50.0, f_max=400.0, sr=1000)
    for pad in ("circular", "reflect"):
        a = FB.fb_transform(wf, cfg, pad, "arrow").orderBy("call_id", "frame_idx").collect()
        b = FB.fb_transform(wf, cfg, pad, "expr").orderBy("call_id", "frame_idx").collect()
        assert len(a) == len(b)
        assert np.allclose([r["re"] for r in a], [r["re"] for r in b], atol=1e-9)
        assert np.allclose([r["im"] for r in a], [r["im"] for r in b], atol=1e-9)


def test_kernel_table_equals_matrix(spark):
    for scale in ("elelog", "mel", "erb"):
        cfg = FB.FilterbankConfig(kernel_size=64, num_channels=6, stride=8, f_min=40.0, f_max=400.0, sr=1000, scale=scale)
        m = FB.kernel_matrix(cfg)
        rows = FB.fb_kernels(spark, cfg).collect()
        got = np.zeros_like(m)
        for r in rows:
            got[r["channel"], r["tap"]] = r["re"] + 1j * r["im"]
        assert np.allclose(got, m, atol=1e-12)


def test_adjoint_identity(spark):
    """<Kx, y> equals <x, K*y> for real x."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=96)
    cfg = FB.FilterbankConfig(kernel_size=16, num_channels=4, stride=8, f_min=60.0, f_max=400.0, sr=1000)
    wf = waves(spark, {1: x})
    c = FB.fb_transform(wf, cfg)
    energy = sum(np.sum(np.square(r["mags"])) for r in c.collect())
    for strategy in ("arrow", "sql"):
        back = FB.fb_adjoint(c, cfg, strategy).orderBy("n").collect()
        assert np.dot(x, [r["re"] for r in back]) == pytest.approx(energy, rel=1e-9)


@pytest.mark.parametrize("kernel, stride", [(40, 16), (24, 24), (8, 16)])
def test_adjoint_in_sql_sums_whole_strides(spark, kernel, stride):
    cfg = FB.FilterbankConfig(kernel_size=kernel, num_channels=3, stride=stride, f_min=50.0, f_max=400.0, sr=1000)
    x = np.random.default_rng(2).normal(size=200)
    wf = spark.createDataFrame([(7, 1000, x.tolist())], "call_id bigint, sr int, samples array<double>")
    c = FB.fb_transform(wf, cfg)
    rows = FB.fb_adjoint(c, cfg, "sql")
    sql = {r["n"]: (r["re"], r["im"]) for r in rows.collect()}
    arrow = {r["n"]: (r["re"], r["im"]) for r in FB.fb_adjoint(c, cfg).collect()}
    assert set(sql) <= set(arrow)
    for n, v in arrow.items():
        assert sql.get(n, (0.0, 0.0)) == pytest.approx(v, abs=1e-9)
    # the groups of every sum over the call are strides, not samples
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate [call_id" in line and "sum(" in line]
    assert grouped and all("AS block" in line for line in grouped)


def test_reflect_needs_enough_samples(spark):
    wf = waves(spark, {1: np.ones(10)})
    with pytest.raises(Exception):
        FR.stft(wf, 1000, 64, 16, pad="reflect", strategy="expr").collect()
    with pytest.raises(ValueError):
        FR.stft_axis(1000, 64, 900.0, 950.0)
    with pytest.raises(ValueError):
        FR.MultiResConfig(coarse_win=9999999)


def test_triangles_and_dct():
    m = FR.tri_matrix(33, 1.0, 500.0, 12, 1000, "elelog")
    assert (m.sum(axis=1) > 0).all()
    assert len(FR.tri_matrix(33, 1.0, 500.0, 12, 1000, "elelog", drop_empty=False)) == 12
    d = FR.dct_matrix(8, 8)
    assert np.allclose(d @ d.T, np.eye(8))
    with pytest.raises(ValueError):
        FR.dct_matrix(4, 4, dct_type=3)


def test_mono_pad_resample(spark):
    df = spark.createDataFrame([(1, 1000, [[1.0, 3.0], [3.0, 5.0]])], "call_id bigint, sr int, samples array<array<double>>")
    assert FR.to_mono(df).first()["samples"] == [2.0, 4.0]
    wf = waves(spark, {1: [1.0, 2.0]})
    assert FR.pad_min(wf, 4).first()["samples"] == [1.0, 2.0, 0.0, 0.0]
    n = np.arange(400)
    tone = np.sin(2 * np.pi * 20 * n / 1000)
    out = FR.resample(waves(spark, {1: tone}), 1000, 500, 16).first()["samples"]
    assert len(out) == 200
    assert np.allclose(out[20:-20], tone[::2][20:-20], atol=2e-2)


def test_mask_of_a_flat_contour(spark, contour_of):
    frames = FR.stft(waves(spark, {1: np.ones(256)}), 1000, 64, 32)
    c = contour_of({1: [60.0] * 4}).withColumn("f0", F.col("frequency") / 2)
    bins = MK.harmonic_mask(c, frames, 1000, 64, 3, 0).filter("frame_idx = 2").select("bin").collect()
    # 30, 60, 90 Hz on a 15.625 Hz grid
    assert sorted(r["bin"] for r in bins) == [2, 4, 6]
    assert sum(w for _, _, w in MK.kernel_values(64, 64, 32)) == pytest.approx(1.0)


# ------------------------------------------------------------------ tracking


def grid(spark, frames, call=1):
    return spark.createDataFrame([(call, [0.1 * i for i in range(len(frames))], frames)], "call_id bigint, times array<double>, frames array<array<double>>")


def test_equal_magnitudes_pick_the_first_channel(spark):
    calls = grid(spark, [[1.0] * 5] * 3)
    axis = [20.0, 21.0, 22.0, 23.0, 24.0]
    assert calls.select(TR.track_causal(F.col("frames"), axis, 1.0).alias("p")).first()["p"] == [0, 0, 0]
    assert calls.select(TR.anchor(F.col("frames")).alias("a")).first()["a"]["channel"] == 0


def test_jump_limits_the_causal_track(spark):
    frames = [[9.0, 0, 0, 0], [1.0, 2.0, 0, 9.0], [0, 0, 3.0, 9.0]]
    calls = grid(spark, [[float(x) for x in f] for f in frames])
    axis = [10.0, 11.0, 12.0, 13.0]
    path = lambda jump: calls.select(TR.track_causal(F.col("frames"), axis, jump).alias("p")).first()["p"]
    assert path(1.0) == [0, 1, 2]
    assert path(None) == [0, 3, 3]


def test_unsorted_axis_and_empty_band_raise(spark):
    calls = grid(spark, [[1.0, 2.0]])
    with pytest.raises(ValueError):
        calls.select(TR.track_causal(F.col("frames"), [2.0, 1.0], 1.0))
    with pytest.raises(ValueError):
        TR.track_ridge(calls, [2.0, 3.0], TR.RidgeConfig())


def brute_viterbi(em, step, smooth, scale, jump):
    n = em.shape[1]
    r = max(1, int(np.floor(jump / step + 1e-9)))
    dp, back = em[0].copy(), []
    for fr in em[1:]:
        new, b = np.zeros(n), np.zeros(n, int)
        for s in range(n):
            options = [(dp[p] - smooth * ((s - p) * step / scale) ** 2, p) for p in range(max(0, s - r), min(n, s + r + 1))]
            new[s], b[s] = max(options)
        dp = new + fr
        back.append(b)
    path = [int(np.argmax(dp))]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("strategy", ["expr", "arrow"])
def test_viterbi_against_brute_force(spark, strategy):
    rng = np.random.default_rng(5)
    em = np.round(rng.normal(size=(9, 7)), 1)
    em[4, 6] = 30.0  # a detour out of reach in one step
    h1 = [20.0 + i for i in range(7)]
    v = H.viterbi(F.col("frames"), h1, 0.5, 1.0, 2.0, strategy)
    got = grid(spark, em.tolist()).select(v.alias("v")).first()["v"]
    assert list(got["idx"]) == brute_viterbi(em, 1.0, 0.5, 1.0, 2.0)
    assert max(abs(np.diff(got["idx"]))) <= 2
    assert np.all(np.abs(np.array(got["hz"]) - [h1[i] for i in got["idx"]]) <= 0.75)


def test_viterbi_ties_take_the_highest_predecessor(spark):
    em = np.zeros((3, 5))
    for strategy in ("expr", "arrow"):
        v = H.viterbi(F.col("frames"), [1.0, 2.0, 3.0, 4.0, 5.0], 0.0, 1.0, 2.0, strategy)
        assert list(grid(spark, em.tolist()).select(v.alias("v")).first()["v"]["idx"]) == brute_viterbi(em, 1.0, 0.0, 1.0, 2.0)


def test_harmonic_stack_gives_h1(spark):
    """Partials 2..8 of 15 Hz: the visible ridge is 30 Hz, F0 is 15 Hz."""
    n = np.arange(4000)
    x = sum(np.cos(2 * np.pi * 15 * k * n / 1000) / k for k in range(2, 9))
    mr = FR.MultiResConfig(sr=1000, hop=200, coarse_n_fft=1024, coarse_win=1000, fine_n_fft=1024, fine_win=1000, fmin=5.0, fmax=200.0)
    cfg = H.HybridConfig(candidate_step=0.5, n_harmonics=8, radius=1.0, bin_radius=1, contrast_sigma=4.0, transition_scale=0.5)
    rows = H.contour_rows(H.track_hybrid_stft(waves(spark, {1: x}), mr, cfg)).orderBy("frame_idx").collect()
    inner = rows[3:-3]
    assert all(abs(r["frequency"] - 30.0) < 1.0 and abs(r["f0"] - 15.0) < 0.5 for r in inner)


def test_duplicate_proposals_are_dropped(spark):
    p = lambda path: {"path": path, "score": 1.0}
    rows = [([p([20.0, 21.0, 22.0]), p([20.2, 21.1, 25.0]), p([40.0, 40.0, 40.0]), p([40.1, 40.1, 40.1])],)]
    df = spark.createDataFrame(rows, "v array<struct<path:array<double>,score:double>>")
    kept = df.select(H.dedupe_proposals(F.col("v")).alias("k")).first()["k"]
    assert [k["path"][0] for k in kept] == [20.0, 40.0]


# ------------------------------------------------------------------ lookups


def test_nearest_takes_the_lower_value_on_ties(spark):
    df = spark.createDataFrame([(1, 1.5), (1, -9.0), (1, 99.0), (1, 1.6)], "call_id bigint, x double")
    axis = [3.0, 1.0, 2.0]
    assert [r["idx"] for r in L.nearest(df, axis, "x").collect()] == [0, 0, 2, 1]
    table = spark.createDataFrame([(1, v) for v in axis], "call_id bigint, v double")
    got = {r["x"]: r["nearest"] for r in L.nearest_by_call(df, table, "x", "v").collect()}
    assert got == {1.5: 1.0, -9.0: 1.0, 99.0: 3.0, 1.6: 2.0}


def test_amplitude_outside_the_grid_is_filled(spark, contour_of):
    frames = spark.createDataFrame([(1, 0, 0.0, [1.0, 2.0]), (1, 1, 0.1, [3.0, 4.0])], "call_id bigint, frame_idx int, time double, mags array<double>")
    c = contour_of({1: [10.0, 20.0, 20.0], 2: [10.0]})
    out = L.amplitude_at(c, frames, [10.0, 20.0], fill=-1.0).orderBy("call_id", "frame_idx").collect()
    assert [r["amplitude"] for r in out] == [1.0, 4.0, -1.0, -1.0]
    assert [r["in_grid"] for r in out] == [True, True, False, False]


def test_blank_grid_has_a_frame(spark):
    wf = waves(spark, {1: [], 2: np.zeros(250)})
    n = {r["call_id"]: r["n"] for r in L.blank_contour(wf, 0.1).groupBy("call_id").agg(F.count("*").alias("n")).collect()}
    assert n == {1: 1, 2: 3}


# ------------------------------------------------------------------ editing


def marked(contour_of, starts, ends, n=8):
    flag = lambda at: {1: [1.0 if i in at else 0.0 for i in range(n)]}
    c = contour_of({1: [10.0 + i for i in range(n)]}, start_point=flag(starts), end_point=flag(ends))
    return c.withColumn("start_point", F.col("start_point").cast("int")).withColumn("end_point", F.col("end_point").cast("int"))


def test_marker_semantics_differ(spark, contour_of):
    c = marked(contour_of, {2}, {4, 6})
    assert values(E.realign(c), "frequency") == [12.0, 13.0, 14.0, 15.0, 16.0]
    assert values(E.realign(c), "time")[0] == 0.0
    assert "start_point" not in E.realign(c).columns
    assert values(E.trim(c)[0], "frequency") == [12.0, 13.0, 14.0]
    d = spark.createDataFrame([(1, 0.8, 1000)], "call_id bigint, duration double, sr int")
    rows, info = E.trim_stretch(c, d, 0.4)
    assert values(rows, "frequency") == [12.0, 13.0, 14.0]
    assert info.first()["rate"] == pytest.approx(0.5)
    assert values(rows, "time") == pytest.approx([0.0, 0.2, 0.4])


def test_calls_without_markers(spark, contour_of):
    c = marked(contour_of, set(), {4})
    assert E.realign(c).count() == 0 and E.trim(c)[0].count() == 0
    d = spark.createDataFrame([(1, 0.8, 1000)], "call_id bigint, duration double, sr int")
    rows, info = E.trim_stretch(c, d, 0.5)
    assert rows.count() == 8 and info.first()["stretched"] is False


def test_correction_counts(spark, contour_of):
    c = contour_of({k: [1.0] * 12 for k in range(1, 6)})
    pts = [(1, 0.2, 7.0), (2, 0.2, 4.0), (2, 0.4, 8.0), (3, 0.3, 4.0), (3, 0.3, 6.0)]
    pts += [(4, t, t**3) for t in (0.0, 0.3, 0.6, 0.9)]
    corr = spark.createDataFrame(pts, "call_id bigint, time double, freq double")
    out = E.apply_corrections(c, corr, 5.0)
    got = {k: values(out.filter(f"call_id = {k}"), "frequency") for k in range(1, 6)}
    assert got[1] == [5.0] * 7 + [1.0] * 5  # constant within half a second, limited to fmax
    assert got[2][1:6] == pytest.approx([1.0, 4.0, 5.0, 5.0, 1.0])
    assert got[3] == [1.0] * 12  # two points at one time leave one knot
    assert got[4][:10] == pytest.approx([(0.1 * i) ** 3 for i in range(10)], abs=1e-9)  # a cubic is reproduced
    assert got[4][10:] == [1.0, 1.0] and got[5] == [1.0] * 12


def test_not_a_knot_equals_the_dense_system():
    rng = np.random.default_rng(5)
    for n in (4, 5, 6, 50):
        x, y = np.cumsum(rng.uniform(0.05, 2.0, n)), rng.normal(size=n)
        h = np.diff(x)
        m, right = np.zeros((n, n)), np.zeros(n)
        for i in range(1, n - 1):
            m[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            right[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
        m[0, :3], m[-1, -3:] = (h[1], -h[0] - h[1], h[0]), (h[-1], -h[-2] - h[-1], h[-2])
        s = np.linalg.solve(m, right)
        mid = (x[:-1] + x[1:]) / 2
        want = (y[:-1] + y[1:]) / 2 - (s[:-1] + s[1:]) * h * h / 16
        assert np.allclose(E.not_a_knot(x, y, mid), want)
        assert np.allclose(E.not_a_knot(x, y, x), y)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_causal_track_over_blocks_equals_a_loop(spark, n):
    rng = np.random.default_rng(n)
    frames = rng.random((n, 6)).tolist()
    df = spark.createDataFrame([(frames,)], "frames array<array<double>>")
    got = df.select(TR.track_causal(F.col("frames"), [float(i) for i in range(6)], 1.0).alias("p")).first()["p"]
    want, prev = [], None
    for fr in frames:
        lo, hi = (0, 5) if prev is None else (max(0, prev - 1), min(5, prev + 1))
        prev = lo + int(np.argmax(fr[lo : hi + 1]))
        want.append(prev)
    assert got == want


def test_not_a_knot_reproduces_cubics():
    x = np.array([0.0, 0.7, 1.1, 2.0, 3.5])
    f = lambda t: 2 * t**3 - t**2 + 0.5 * t - 3
    at = np.linspace(0, 3.5, 23)
    assert np.allclose(E.not_a_knot(x, f(x), at), f(at))


def test_markers_fall_back_to_voiced_frames(spark, contour_of):
    c = contour_of({1: [0, 3, 4, 0], 2: [0, 0, 0, 0]})
    b = spark.createDataFrame([(1, 0.26, None)], "call_id bigint, start_s double, end_s double")
    out = E.assign_markers(c, b)
    assert values(out.filter("call_id = 1"), "start_point") == [0, 0, 0, 1]
    assert values(out.filter("call_id = 1"), "end_point") == [0, 0, 1, 0]
    assert values(out.filter("call_id = 2"), "start_point") == [0] * 4


def test_short_traces_are_left_out(spark):
    px = spark.createDataFrame([(1, x, 5) for x in range(0, 10, 3)] + [(2, 0, 5), (2, 2, 5)], "trace_id bigint, x int, y int")
    out = E.trace_to_contour(px, E.TraceConfig(width=10, height=11))
    assert [r["trace_id"] for r in out.select("trace_id").distinct().collect()] == [1]
    assert set(round(r["f0"], 9) for r in out.collect()) == {20.0}


# ------------------------------------------------------------------ statistics


def test_ranks_do_not_depend_on_buckets(spark):
    rng = np.random.default_rng(2)
    data = np.round(rng.exponential(3.0, 500), 1)
    data[:170] = 2.5  # one value holds a third
    df = spark.createDataFrame([(float(v),) for v in data], "d double")
    for buckets in (1, 3, 40):
        rows = RK.value_ranks(df, "d", buckets).orderBy("value").collect()
        assert [r["cum"] for r in rows] == [int((data <= r["value"]).sum()) for r in rows]
    got = RK.exact_percentiles(df, "d", [10, 50, 99]).first()
    assert [got["p10"], got["p50"], got["p99"]] == pytest.approx(list(np.percentile(data, [10, 50, 99])))


def test_window_recommendation(spark):
    df = spark.createDataFrame([(i, 2.2 if i < 9 else 0.5) for i in range(10)], "call_id bigint, duration double")
    assert [r["size"] for r in ST.window_coverage(df).filter("recommended").collect()] == [2.0]
    low = spark.createDataFrame([(i, 2.2 if i < 8 else 0.5) for i in range(10)], "call_id bigint, duration double")
    assert [r["size"] for r in ST.window_coverage(low).filter("recommended").collect()] == [2.0]
    none = spark.createDataFrame([(i, 0.5) for i in range(4)], "call_id bigint, duration double")
    assert ST.window_coverage(none).filter("recommended").count() == 0


def test_perfect_prediction(spark, contour_of):
    c = contour_of({1: [20, 21, 23, 0, 30, 28]})
    e = ST.evaluate(c, c).first()
    assert e["mae_hz"] == 0.0 and e["within_25"] == 1.0 and e["fm_corr"] == pytest.approx(1.0) and e["frames"] == 5


# ------------------------------------------------------------------ clustering


def points(spark, xs):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(xs)], "call_id bigint, features array<double>")


@pytest.mark.parametrize("block_rows", [2000, 7])
def test_neighbours_against_brute_force(spark, block_rows):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(30, 3)), np.tile([[5.0, 5.0, 5.0]], (20, 1)), rng.normal(size=(10, 3)) * 9])
    got = K.knn(points(spark, x), 4, pivots=6, block_rows=block_rows).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for i in range(len(x)):
        order = sorted((d[i, j], j) for j in range(len(x)) if j != i)[:4]
        mine = sorted((r["rank"], r["distance"], r["neighbour"]) for r in got if r["call_id"] == i)
        assert [m[2] for m in mine] == [o[1] for o in order]
        assert [m[1] for m in mine] == pytest.approx([o[0] for o in order])


def test_neighbours_compute_features_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    df = points(spark, np.random.default_rng(1).normal(size=(40, 3))).mapInPandas(counted, "call_id bigint, features array<double>")
    assert K.knn(df, 3).count() == 120 and seen.value == 40


def test_neighbours_far_from_the_origin(spark):
    """Small distances between large numbers, ties and two rows of one id."""
    x = 1e6 + np.array([[0.0, 0], [1e-3, 0], [0, 1e-3], [2e-3, 0], [0, 5e-3]])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "call_id bigint, features array<double>")
    twice = df.union(df.filter("call_id = 4"))
    got = {(r["call_id"], r["rank"]): r["neighbour"] for r in K.knn(twice, 2, pivots=3).collect()}
    assert [got[0, 1], got[0, 2]] == [1, 2] and got[3, 1] == 1 and got[4, 1] == 2
    assert all(call != other for (call, _), other in got.items())


def silhouette_by_hand(p, lab):
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(p)):
        own = (lab == lab[i]) & (np.arange(len(p)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a = d[i][own].mean()
        b = min(d[i][lab == c].mean() for c in set(lab.tolist()) - {int(lab[i])})
        out.append((b - a) / max(a, b))
    return out


@pytest.mark.parametrize("block_rows", [2000, 5])
def test_silhouette_against_brute_force(spark, block_rows):
    rng = np.random.default_rng(6)
    p = rng.normal(size=(23, 2))
    lab = np.array([i % 3 for i in range(22)] + [7])
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(p, lab))], "call_id bigint, x double, y double, cluster int")
    got = {r["call_id"]: r["silhouette"] for r in K.silhouette(df, block_rows=block_rows).collect()}
    assert [got[i] for i in range(23)] == pytest.approx(silhouette_by_hand(p, lab))


def test_standardise_keeps_constant_columns(spark):
    z = K.standardise(points(spark, [[1, 5], [3, 5]])).orderBy("call_id").collect()
    assert [r["features"] for r in z] == [[-1.0, 0.0], [1.0, 0.0]]


def test_cluster_limits(spark):
    assert K.neighbour_count(50, 10) == 9 and K.neighbour_count(1, 10) == 2
    two = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0)], "call_id bigint, x double, y double")
    with pytest.raises(ValueError):
        K.kmeans(two, 2)


def test_separated_groups_are_found(spark, contour_of):
    rng = np.random.default_rng(8)
    calls = {i: (40 if i % 2 else 24) + rng.normal(size=12) * 0.2 + np.linspace(0, 4 if i % 2 else -4, 12) for i in range(20)}
    job = J.cluster_contours_job(spark, contour_of(calls), points=16, k=2)
    lab = {r["call_id"]: r["cluster"] for r in job.assignments.collect()}
    assert len({lab[i] for i in range(0, 20, 2)}) == 1 and len(set(lab.values())) == 2
    assert job.silhouette.first()["silhouette"] > 0.5
    assert job.assignments.columns == list(SO.ASSIGNMENT_COLUMNS)


# ------------------------------------------------------------------ sources and jobs


def test_contour_folder(spark, tmp_path):
    (tmp_path / "a (1).f0.csv").write_text("time,F0\n0.0,20.5\n0.1,oops\n0.2,-3\n")
    (tmp_path / "b+c 5%.f0.csv").write_text("time,F0\n0.0,30\n")
    rows = SO.read_contours(spark, str(tmp_path), "peak").orderBy("call_id", "time").collect()
    assert [(r["call_id"], r["frequency"]) for r in rows] == [("a (1)", 20.5), ("a (1)", 0.0), ("a (1)", 0.0), ("b+c 5%", 30.0)]
    with pytest.raises(ValueError):
        SO.frequency_column(["time", "hz"])


def test_per_call_sink(spark, tmp_path, contour_of):
    c = contour_of({1: [20.123456789], 2: [30.0]}).withColumn("version", F.lit("v"))
    SO.write_contours(c, str(tmp_path / "out"), per_call=True)
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert {(r["call_id"], r["frequency"]) for r in back.collect()} == {(1, "20.123457"), (2, "30.000000")}


def test_store_lookup(spark):
    meta = spark.createDataFrame(
        [("stft_500", "stft", {"sr": "16000", "win": "8192"}), ("stft_b", "stft", {"sr": "16000.0", "win": "4096"}), ("stft_a", "stft", {"sr": "16000"})],
        "repr_id string, representation string, parameters map<string,string>",
    )
    find = lambda want, **kw: [r["repr_id"] for r in SO.find_store(meta, "stft", want, "stft_500", **kw).collect()]
    assert find({"sr": 16000}) == ["stft_500"]
    assert find({"sr": 16000, "win": 4096}) == ["stft_b"]
    assert find({"sr": 8000}) == []
    with pytest.raises(ValueError):
        find({"win": 8192}, requested="stft_b")


def test_ordinal_resume_and_missing(spark):
    df = spark.createDataFrame([(i,) for i in (9, 2, 5, 7)], "call_id bigint")
    assert sorted(r["call_id"] for r in SO.from_ordinal(df, 3).collect()) == [7, 9]
    assert SO.from_ordinal(df, 5).count() == 0
    assert SO.missing_calls(df, df.filter("call_id > 4")).first()["call_id"] == 2


def test_extraction_isolates_bad_calls(spark, tmp_path):
    n = np.arange(2000)
    wf = waves(spark, {1: np.cos(2 * np.pi * 30 * n / 1000), 2: [0.0]})
    cfg = J.ExtractConfig(method="stft", sr=1000, n_fft=256, frame_resolution=0.064, ridge=TR.RidgeConfig(max_jump=8.0))
    sink = str(tmp_path / "sink")
    rep = {r["call_id"]: r["status"] for r in J.extract_dataset(spark, wf, sink, cfg).collect()}
    assert rep == {1: "ok", 2: "failed"}
    before = spark.read.parquet(sink).count()
    J.extract_dataset(spark, wf, sink, cfg)
    assert spark.read.parquet(sink).count() == before


def test_extraction_tells_why_calls_fail(spark, tmp_path):
    tone = np.cos(2 * np.pi * 30 * np.arange(2000) / 1000).tolist()
    rows = [(1, 1000, tone), (2, 1000, [1.0]), (3, 1000, None), (4, 1000, [float("nan"), None, float("inf")] * 200), (5, 500, tone), (6, None, tone)]
    rows.append((7, 1000, [float("nan") if i % 50 == 0 else v for i, v in enumerate(tone)]))
    wf = spark.createDataFrame(rows, "call_id long, sr int, samples array<double>")
    cfg = J.ExtractConfig(method="stft", sr=1000, n_fft=256, frame_resolution=0.064, ridge=TR.RidgeConfig(max_jump=8.0))
    rep = {r["call_id"]: (r["status"], r["reason"]) for r in J.extract_dataset(spark, wf, str(tmp_path / "sink"), cfg).collect()}
    rate = ("failed", "the sampling rate differs")
    short, none, bad = "fewer than 2 samples", "the call has no samples", "a sample is not finite"
    assert {k: rep[k] for k in range(1, 7)} == {1: ("ok", None), 2: ("failed", short), 3: ("failed", none), 4: ("failed", bad), 5: rate, 6: rate}
    assert rep[7] == ("failed", bad)


def test_filterbank_errors_are_rows(spark):
    cfg = FB.FilterbankConfig(kernel_size=33, num_channels=5, stride=7, f_min=50.0, f_max=400.0, sr=1000)
    calls = [(1, [1.0, 2.0] * 40), (2, [1.0] * 16), (3, None), (4, [0.5] * 17)]
    wf = spark.createDataFrame(calls, "call_id long, samples array<double>")
    got = FB.fb_transform(wf, cfg, "reflect", errors="rows").collect()
    assert {r.call_id: r.reason for r in got if r.reason} == {2: FB.SHORT_REFLECT, 3: "the call has no samples"}
    assert all((r.frame_idx is None) == (r.reason is not None) for r in got)
    assert sorted({r.call_id for r in got if r.reason is None}) == [1, 4]
    with pytest.raises(Exception, match="reflect padding"):
        FB.fb_transform(wf.filter("call_id <> 3"), cfg, "reflect").collect()


def test_blocks_do_not_show_in_long_calls(spark):
    """Calls of many blocks, of one block, and shorter than the kernel, at strides that do and do not divide them."""
    rng = np.random.default_rng(11)
    calls = {i: rng.normal(size=n) for i, n in enumerate([20, 33, 34, 500, 4001])}
    for stride in (1, 8, 50):
        cfg = FB.FilterbankConfig(kernel_size=33, num_channels=5, stride=stride, f_min=50.0, f_max=400.0, sr=1000)
        c = -(-FB.kernel_plan(cfg).kernel_size // 2)
        g = FB.kernel_matrix(cfg)[FB.first_channel(cfg) :]
        got = {}
        for r in FB.fb_transform(waves(spark, calls), cfg).collect():
            got.setdefault(r.call_id, {})[r.frame_idx] = np.array(r.re) + 1j * np.array(r.im)
        for i, x in calls.items():
            x = np.concatenate([x, np.zeros(max(0, g.shape[1] - len(x)))])
            whole = np.fft.ifft(np.fft.fft(g, n=len(x), axis=1) * np.fft.fft(x), axis=1)
            at = np.arange(0, len(x), stride)
            assert sorted(got[i]) == list(range(len(at)))
            assert np.allclose([got[i][m] for m in range(len(at))], whole[:, (at + c) % len(x)].T, atol=1e-9)


def test_stored_grids_serve_the_hybrid_tracker(spark, tmp_path):
    n = np.arange(1600) / 1000
    wf = waves(spark, {i: np.sin(2 * np.pi * (40 + 5 * i) * n) + 0.5 * np.sin(2 * np.pi * (80 + 10 * i) * n) for i in range(3)})
    fb = FB.FilterbankConfig(kernel_size=400, num_channels=96, stride=32, f_min=12.0, f_max=400.0, sr=1000)
    cfg = J.H.HybridConfig(candidate_step=1.0)
    rows = lambda d: sorted((r.call_id, r.frame_idx, round(r.frequency, 6), round(r.confidence, 6)) for r in d.collect())
    direct = rows(J.H.contour_rows(J.H.track_hybrid_fb(wf, fb, cfg)))
    store = str(tmp_path / "store")
    J.fill_fb_store(spark, wf.filter("call_id = 1"), store, fb)
    assert rows(J.extract_from_store(spark, wf, store, fb, hybrid=cfg)) == direct and direct


def test_constants_fold(spark):
    plan = spark.range(1).select(A.dlit([1.0, 2.0]).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan.lower() and "jsontostructs" not in plan.lower()


def test_segments_stitch_to_the_whole_transform(spark):
    rng = np.random.default_rng(4)
    calls = [(i, rng.normal(size=n).tolist()) for i, n in enumerate([0, 5, 64, 200, 1003])]
    wf = spark.createDataFrame(calls, "call_id long, samples array<double>")
    for center in (True, False):
        whole = FR.stft(wf, 1000, 64, 16, center=center)
        parts = FR.stft_segmented(wf, 1000, 64, 16, frames_per_segment=5, center=center)
        rows = lambda d: sorted((r.call_id, r.frame_idx, r.time, [round(m, 9) for m in r.mags]) for r in d.collect())
        assert rows(parts) == rows(whole)


def test_mean_density_takes_all_calls_and_keeps_bins(spark):
    t = np.arange(128) / 1000
    tone = np.sin(2 * np.pi * 250 * t)
    wf = spark.createDataFrame([(i, (tone * (i + 1)).tolist()) for i in range(120)] + [(500, [])], "call_id long, samples array<double>")
    psd = {r.bin: r.psd for r in ST.mean_psd(wf, 1000, 128).collect()}
    each = [r.psd for r in ST.welch_psd(wf, 1000, 128).collect() if r.psd is not None]
    assert len(each) == 120 and psd[32] == pytest.approx(np.mean([p[32] for p in each]))
    short = spark.createDataFrame([(1, tone[:64].tolist())], "call_id long, samples array<double>")
    peak = max(ST.mean_psd(short, 1000, 128).collect(), key=lambda r: r.psd)
    assert peak.freq_hz == 250.0


def test_positive_medians_equal_numpy(spark):
    rng = np.random.default_rng(8)
    calls = {1: rng.lognormal(0, 4, 501), 2: rng.integers(0, 4, 400) * 1.0, 3: np.full(90, 2.5), 4: np.zeros(5), 5: np.array([5e-324, 1e308]), 6: np.array([1.0, np.inf, np.inf])}
    rows = [(k, float(x)) for k, v in calls.items() for x in v] + [(1, None), (1, -3.0), (7, None)]
    df = spark.createDataFrame(rows, "call_id bigint, magnitude double")
    for parts in (1, 32):
        got = {r["call_id"]: r["median"] for r in RK.positive_medians(df, "magnitude", parts=parts).collect()}
        assert got == {k: pytest.approx(float(np.median(v[v > 0]))) for k, v in calls.items() if (v > 0).any()}
    assert RK.positive_medians(df.limit(0), "magnitude").count() == 0


@pytest.mark.parametrize("ddl", ["string", "date", "decimal(12,2)"])
def test_ordinals_of_any_ordered_type(spark, ddl):
    calls = spark.range(700).select(F.expr("pmod(xxhash64(id), 500)").alias("d"))
    made = {"string": "concat('é', d)", "date": "date_add(DATE '2020-01-01', cast(d as int))", "decimal(12,2)": "cast(d / 4 as decimal(12,2))"}[ddl]
    df = calls.selectExpr(f"{made} AS call_id").union(spark.range(3).selectExpr(f"cast(NULL as {ddl}) AS call_id"))
    want = sorted({r[0] for r in df.collect() if r[0] is not None})
    ranks = RK.value_ranks(df.distinct(), "call_id", 16).collect()
    assert {r["value"]: r["cum"] for r in ranks} == {v: i + 1 for i, v in enumerate(want)}
    assert sorted({r[0] for r in SO.from_ordinal(df, 100).collect()}) == want[99:]
    assert SO.from_ordinal(df, len(want) + 1).count() == 0
