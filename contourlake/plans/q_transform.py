"""Registered queries of transforms and masks (M rows) and of the trackers that start from waveforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import filterbank as FB
from ..operators import frames as FR
from ..operators import hybrid as H
from ..operators import lookup as L
from ..operators import mask as MK
from ..operators import track as TR
from .base import query, r6
from .q_scalar import aud_sql, hz_sql
from .q_stats import rounded
from ..session import scratch_table
from . import jobs as J
from .q_track import conf_ctes, lattice_ctes, proposal_ctes, track_ctes, viterbi_ctes

SR = 1000


def grid_rows(frames, places=6, first=0):
    return frames.select("call_id", "frame_idx", F.posexplode("mags").alias("b", "m")).select(
        "call_id", "frame_idx", (F.col("b") + first).alias("bin"), r6("m", places).alias("magnitude")
    )


def spectrum_ctes(
    name: str, n_fft: int, hop: int, win: int | None = None, lo: int = 0, hi: int | None = None, pad: str = "zero"
) -> dict[str, str]:
    """``name``: (call_id, frame_idx, bin, magnitude) of the centred transform of ``sample``."""
    win = win or n_fft
    hi = n_fft // 2 if hi is None else hi
    start, half = (n_fft - win) // 2, n_fft // 2
    index = f"m * {hop} + k - {half}"
    if pad == "reflect":
        index = f"CASE WHEN abs({index}) < total THEN abs({index}) ELSE 2 * (total - 1) - ({index}) END"
    return {
        f"{name}_w": f"""SELECT z.call_id, m, k, s.x * (5e-1 - 5e-1 * cos(2e0 * pi() * (k - {start}) / {win}e0)) AS y FROM
          (SELECT call_id, count(*) AS total FROM sample GROUP BY 1) z JOIN (SELECT range AS m FROM range(400)) f ON m * {hop} <= total + {2 * half - n_fft}
          CROSS JOIN (SELECT range AS k FROM range({start}, {start + win})) JOIN sample s ON s.call_id = z.call_id AND s.n = {index}""",
        name: f"""SELECT call_id, CAST(m AS INT) AS frame_idx, CAST(b AS INT) AS bin,
           sqrt(pow(sum(y * cos(2e0 * pi() * ((k * b) % {n_fft}) / {n_fft}e0)), 2) + pow(sum(y * sin(2e0 * pi() * ((k * b) % {n_fft}) / {n_fft}e0)), 2)) AS magnitude
          FROM {name}_w CROSS JOIN (SELECT range AS b FROM range({lo}, {hi + 1})) GROUP BY 1, 2, 3""",
    }


SPEC = spectrum_ctes("spec", 64, 32)
_SPEC_SQL = "SELECT call_id, frame_idx, bin, round(magnitude, 6) + 0e0 AS magnitude FROM spec"


@query("M1_stft", _SPEC_SQL, **SPEC)
def _(t):
    return grid_rows(FR.stft(t.waveform, SR, 64, 32))


@query("M1_stft_expr", _SPEC_SQL, **SPEC)
def _(t):
    return grid_rows(FR.stft(t.waveform, SR, 64, 32, strategy="expr"))


@query(
    "M1_stft_band_reflect",
    "SELECT call_id, frame_idx, bin, round(magnitude, 6) + 0e0 AS magnitude FROM spec",
    **spectrum_ctes("spec", 128, 32, 96, 3, 25, "reflect"),
)
def _(t):
    return grid_rows(FR.stft(t.waveform, SR, 128, 32, 96, 22.5, 200.0, pad="reflect"), first=3)


MR = FR.MultiResConfig(sr=SR, hop=64, coarse_n_fft=256, coarse_win=256, fine_n_fft=256, fine_win=128, fmin=5.0, fmax=200.0)


@query(
    "M2_multires_stft",
    "SELECT call_id, frame_idx, bin, round(c.magnitude, 6) + 0e0 AS coarse, round(f.magnitude, 6) + 0e0 AS fine FROM crs c JOIN fin f USING (call_id, frame_idx, bin)",
    **spectrum_ctes("crs", 256, 64, 256, 2, 51),
    **spectrum_ctes("fin", 256, 64, 128, 2, 51),
)
def _(t):
    both = FR.multires_stft(t.waveform, MR)
    z = F.posexplode(F.arrays_zip("coarse", "fine")).alias("frame_idx", "z")
    cells = both.select("call_id", z).select(
        "call_id", "frame_idx", F.posexplode(F.arrays_zip("z.coarse", "z.fine")).alias("b", "y")
    )
    return cells.select(
        "call_id",
        "frame_idx",
        (F.col("b") + 2).alias("bin"),
        r6(F.col("y")["coarse"]).alias("coarse"),
        r6(F.col("y")["fine"]).alias("fine"),
    )


# ---------------------------------------------------------------- filterbank

FBC = FB.FilterbankConfig(kernel_size=64, num_channels=8, stride=32, f_min=20.0, f_max=400.0, sr=SR, supp_mult=0.3)
_A0, _A1 = aud_sql("elelog", "20e0"), aud_sql("elelog", "400e0")
KERN = {
    "f_ch": f"""SELECT CAST(range AS INT) AS channel, CASE WHEN range = 0 THEN 20e0 WHEN range = 7 THEN 400e0 ELSE
        {hz_sql("elelog", f"({_A0} + ({_A1} - {_A0}) * range / 7e0)")} END AS fc FROM range(8)""",
    "f_sup": """SELECT channel, fc, CASE WHEN channel = 0 THEN 64 WHEN channel = 7 THEN 25 ELSE
        CAST(least(64e0, round_even(7e-1 * 1e4 / fc + 3e-1 * 64, 0)) AS INT) END AS support FROM f_ch""",
    "f_gain": "SELECT sqrt(greatest(floor(min(support) / 2e0), 1e0)) AS g FROM f_sup",
    "f_ker": """SELECT channel, fc, support, CAST(tap AS INT) AS tap, h * g * CASE WHEN channel = 0 THEN sqrt(5e-1) ELSE cos(2e0 * pi() * fc * tap / 1e3) END AS re,
         h * g * CASE WHEN channel = 0 THEN 0e0 ELSE sin(2e0 * pi() * fc * tap / 1e3) END AS im FROM
        (SELECT channel, fc, support, tap, CASE WHEN p >= 0 AND p < w THEN (5e-1 - 5e-1 * cos(2e0 * pi() * p / (w - 1))) / (5e-1 * (w - 1)) ELSE 0e0 END AS h FROM
          (SELECT channel, fc, support, range AS tap, support AS w, range - floor((64 - support) / 2e0) AS p FROM f_sup, range(64))) CROSS JOIN f_gain""",
}


@query(
    "M3_fb_kernels",
    """SELECT call_id, CAST(floor(n / 64e0) AS INT) AS block, channel, support, round(sum(x * re), 6) + 0e0 AS re, round(sum(x * im), 6) + 0e0 AS im
   FROM sample JOIN f_ker ON tap = n % 64 GROUP BY 1, 2, 3, 4""",
    **KERN,
)
def _(t):
    """Kernel table correlated with consecutive 64-sample blocks."""
    k = FB.fb_kernels(t.spark, FBC)
    s = t.sample.withColumn("block", F.floor(F.col("n") / 64).cast("int"))
    return (
        s.join(F.broadcast(k), F.col("n") % 64 == F.col("tap"))
        .groupBy("call_id", "block", "channel", "support")
        .agg(r6(F.sum(s["x"] * k["re"])).alias("re"), r6(F.sum(s["x"] * k["im"])).alias("im"))
    )


def coeff_ctes(reflect: bool) -> dict[str, str]:
    i = "m * 32 - tap + 32"
    if reflect:
        idx = f"CASE WHEN {i} < 0 THEN -({i}) WHEN {i} >= total THEN 2 * (total - 1) - ({i}) ELSE {i} END"
    else:
        idx = f"(({i}) % total + total) % total"
    return {
        **KERN,
        "f_len": "SELECT call_id, CAST(count(*) AS BIGINT) AS total FROM sample GROUP BY 1",
        "f_tap": f"""SELECT l.call_id, CAST(m AS INT) AS frame_idx, k.channel, k.re, k.im, {idx} AS n FROM f_len l
          JOIN (SELECT range AS m FROM range(400)) ON m < ceil(total / 32e0) CROSS JOIN f_ker k""",
        "f_co": """SELECT call_id, frame_idx, channel, sum(re * x) AS re, sum(im * x) AS im FROM f_tap JOIN sample USING (call_id, n) GROUP BY 1, 2, 3""",
    }


_CO = "SELECT call_id, frame_idx, channel, round(re, 6) + 0e0 AS re, round(im, 6) + 0e0 AS im, round(sqrt(re * re + im * im), 6) + 0e0 AS magnitude FROM f_co"


def _coeff_rows(c):
    z = F.posexplode(F.arrays_zip("re", "im", "mags")).alias("channel", "z")
    return c.select("call_id", "frame_idx", z).select(
        "call_id", "frame_idx", "channel", r6("z.re").alias("re"), r6("z.im").alias("im"), r6("z.mags").alias("magnitude")
    )


for _pad in ("circular", "reflect"):
    for _strategy in ("arrow", "expr"):

        @query(f"M4_fb_transform_{_pad}_{_strategy}", _CO, **coeff_ctes(_pad == "reflect"))
        def _(t, pad=_pad, strategy=_strategy):
            return _coeff_rows(FB.fb_transform(t.waveform, FBC, pad, strategy))


_ADJ = """SELECT call_id, n, round(sum(yr * re + yi * im), 6) + 0e0 AS re, round(sum(yi * re - yr * im), 6) + 0e0 AS im FROM
   (SELECT c.call_id, CAST(((c.frame_idx * 32 - k.tap + 32) % len + len) % len AS INT) AS n, c.re AS yr, c.im AS yi, k.re, k.im FROM f_co c JOIN f_ker k USING (channel)
      JOIN (SELECT call_id, (max(frame_idx) + 1) * 32 AS len FROM f_co GROUP BY 1) USING (call_id)) GROUP BY 1, 2"""

for _name, _strategy in (("M5_fb_adjoint", "arrow"), ("M5_fb_adjoint_sql", "sql")):

    @query(_name, _ADJ, **coeff_ctes(False))
    def _(t, strategy=_strategy):
        return rounded(FB.fb_adjoint(FB.fb_transform(t.waveform, FBC), FBC, strategy))


@query(
    "M6_fb_response",
    """SELECT call_id, frame_idx, round(sum(magnitude * psd), 6) + 0e0 AS weighted FROM tf JOIN
   (SELECT b, sum(a * a + c * c + d * d + e * e) AS psd FROM (SELECT channel, b, sum(re * cs + im * sn) AS a, sum(im * cs - re * sn) AS c, sum(re * cs - im * sn) AS d, sum(-im * cs - re * sn) AS e FROM
      (SELECT *, cos(2e0 * pi() * ((b * tap) % 1000) / 1e3) AS cs, sin(2e0 * pi() * ((b * tap) % 1000) / 1e3) AS sn FROM f_ker CROSS JOIN (SELECT range AS b FROM range(500))) GROUP BY 1, 2) GROUP BY 1)
   ON b = round_even(freq_hz, 0) GROUP BY 1, 2""",
    **KERN,
)
def _(t):
    """Grid energy weighted by the filterbank's total response at each channel."""
    psd = FB.total_response(FB.fb_response(t.spark, FBC))
    j = t.tf.join(F.broadcast(psd), F.rint("freq_hz").cast("int") == F.col("bin"))
    return j.groupBy("call_id", "frame_idx").agg(r6(F.sum(F.col("magnitude") * F.col("psd"))).alias("weighted"))


# ---------------------------------------------------------------- triangular filters and cepstra

SC = FR.SpectrogramConfig(sr=SR, n_fft=64, win=64, hop=32, fmin=1.0, fmax=500.0, n_filters=12, pad="reflect")


def tri_ctes(scale: str, norm: bool) -> dict[str, str]:
    lo, hi = aud_sql(scale, "1e0"), aud_sql(scale, "5e2")
    first = "0e0" if scale == "elelog" else "1e0"
    return {
        "tri_pt": f"""SELECT CAST(range AS INT) AS i, CASE WHEN range = 0 THEN {first} WHEN range = 13 THEN 5e2 ELSE {hz_sql(scale, f"({lo} + ({hi} - {lo}) * range / 13e0)")} END AS f FROM range(14)""",
        "tri_all": f"""SELECT a.i, CAST(b AS INT) AS bin, greatest(0e0, least((15625e-3 * b - a.f) / (m.f - a.f), (c.f - 15625e-3 * b) / (c.f - m.f))){" * 2e0 / (c.f - a.f)" if norm else ""} AS w
          FROM tri_pt a JOIN tri_pt m ON m.i = a.i + 1 JOIN tri_pt c ON c.i = a.i + 2 CROSS JOIN (SELECT range AS b FROM range(33))""",
        "tri": """SELECT CAST(dense_rank() OVER (ORDER BY i) - 1 AS INT) AS filter, bin, w FROM tri_all WHERE i IN (SELECT i FROM tri_all GROUP BY 1 HAVING sum(w) > 0)""",
    }


RSPEC = spectrum_ctes("spec", 64, 32, pad="reflect")


@query(
    "M7_tri_fb",
    "SELECT call_id, frame_idx, filter AS channel, round(sum(magnitude * w), 6) + 0e0 AS magnitude FROM spec JOIN tri USING (bin) GROUP BY 1, 2, 3",
    **SPEC,
    **tri_ctes("mel", True),
)
def _(t):
    fb = FR.tri_fb(t.spark, 33, 1.0, 500.0, 12, SR, scale="mel", norm="slaney")
    m = fb.select(F.col("filter").alias("outer"), F.col("bin").alias("inner"), "weight")
    axis, _ = FR.stft_axis(SR, 64)
    tf = FR.explode_frames(FR.stft(t.waveform, SR, 64, 32), axis)
    return L.apply_matrix(tf, m).select("call_id", "frame_idx", "channel", r6("magnitude").alias("magnitude"))


def _aud(power: str) -> dict[str, str]:
    return {
        "aud": f"SELECT call_id, frame_idx, filter AS channel, sum(pow(magnitude, {power}) * w) AS magnitude FROM spec JOIN tri USING (bin) GROUP BY 1, 2, 3"
    }


_AUD_SQL = "SELECT call_id, frame_idx, channel, round(magnitude, 6) + 0e0 AS magnitude FROM aud"


def _channel_rows(frames):
    return grid_rows(frames).withColumnRenamed("bin", "channel")


@query("M8_aud_spectrogram", _AUD_SQL, **RSPEC, **tri_ctes("elelog", False), **_aud("1e0"))
def _(t):
    return _channel_rows(FR.aud_spectrogram(t.waveform, SC))


MEL = FR.SpectrogramConfig(
    sr=SR, n_fft=64, win=64, hop=32, fmin=1.0, fmax=500.0, n_filters=12, pad="reflect", scale="mel", power=2.0
)


@query("M8_mel_spectrogram", _AUD_SQL, **RSPEC, **tri_ctes("mel", False), **_aud("2e0"))
def _(t):
    return _channel_rows(FR.aud_spectrogram(t.waveform, MEL))


def cep_ctes(src: str, log: bool) -> dict[str, str]:
    v = "ln(magnitude + 1e-10)" if log else "magnitude"
    return {
        "cep": f"""SELECT call_id, frame_idx, CAST(k AS INT) AS channel, sum({v} * cos(pi() / nf * (channel + 5e-1) * k)) * sqrt(2e0 / any_value(nf)) * CASE WHEN k = 0 THEN sqrt(5e-1) ELSE 1e0 END AS magnitude
          FROM {src} CROSS JOIN (SELECT count(DISTINCT filter) AS nf FROM tri) CROSS JOIN (SELECT range AS k FROM range(6)) GROUP BY 1, 2, k"""
    }


_CEP = "SELECT call_id, frame_idx, channel, round(magnitude, 6) + 0e0 AS magnitude FROM cep"


@query("M9_cepstra", _CEP, **RSPEC, **tri_ctes("elelog", False), **_aud("1e0"), **cep_ctes("aud", True))
def _(t):
    return _channel_rows(FR.cepstra(FR.aud_spectrogram(t.waveform, SC), len(SC.matrix()), 6, log=True))


# ---------------------------------------------------------------- masks

MASK = {
    "k_n": "SELECT call_id, count(*) AS n FROM contour GROUP BY 1",
    "k_m": "SELECT call_id, CAST(floor(count(*) / 32e0) + 1 AS BIGINT) AS m FROM sample GROUP BY 1",
    "k_f0": """SELECT g.call_id, g.frame_idx, l.f + (r.f - l.f) * (x - lo) AS f0 FROM
       (SELECT *, CAST(least(floor(x), n - 1) AS INT) AS lo, CAST(least(floor(x) + 1, n - 1) AS INT) AS hi FROM
         (SELECT call_id, n, CAST(range AS INT) AS frame_idx, greatest((range + 5e-1) * n / m - 5e-1, 0e0) AS x FROM k_n JOIN k_m USING (call_id), range(400) WHERE range < m)) g
       JOIN (SELECT call_id, frame_idx AS i, frequency / 2e0 AS f FROM contour) l ON l.call_id = g.call_id AND l.i = g.lo
       JOIN (SELECT call_id, frame_idx AS i, frequency / 2e0 AS f FROM contour) r ON r.call_id = g.call_id AND r.i = g.hi""",
    "k_bin": """SELECT DISTINCT call_id, frame_idx, CAST(greatest(least(greatest(least(round_even(k * f0 / 15625e-3, 0), 32), 0) + o, 32), 0) AS INT) AS bin
       FROM k_f0 CROSS JOIN (SELECT range AS k FROM range(1, 9)) CROSS JOIN (SELECT range - 1 AS o FROM range(3)) WHERE k * f0 > 0 AND k * f0 <= 5e2""",
    # kernel of the 64/64/32 transform: dual window, two-sided spectrum, peak normalised, floored, sum normalised
    "k_dual": "SELECT k, w, w / greatest(sum(w * w) OVER (PARTITION BY k % 32), 1e-8) AS d FROM (SELECT range AS k, 5e-1 - 5e-1 * cos(2e0 * pi() * range / 64e0) AS w FROM range(64))",
    "k_raw": """SELECT m, b, sqrt(pow(sum(y * cos(2e0 * pi() * ((k * b) % 64) / 64e0)), 2) + pow(sum(y * sin(2e0 * pi() * ((k * b) % 64) / 64e0)), 2)) AS v FROM
       (SELECT m, h.k, d.d * h.w AS y FROM (SELECT range AS m FROM range(3)) CROSS JOIN k_dual h JOIN k_dual d ON d.k = m * 32 + h.k - 32) CROSS JOIN (SELECT range AS b FROM range(64)) GROUP BY 1, 2""",
    "k_on": "SELECT m, CAST((b + 32) % 64 AS INT) AS i, v / (SELECT max(v) FROM k_raw) AS v FROM k_raw WHERE v / (SELECT max(v) FROM k_raw) >= 1e-3",
    "k_box": "SELECT min(i) AS i0, max(i) - min(i) + 1 AS ni, min(m) AS m0, max(m) - min(m) + 1 AS nm, sum(v) AS s FROM k_on",
    "k_ker": """SELECT CAST(floor((ni + 1 - ni % 2) / 2e0) - (i - i0) AS INT) AS dk, CAST(floor((nm + 1 - nm % 2) / 2e0) - (m - m0) AS INT) AS dm, v / s AS w FROM k_on CROSS JOIN k_box""",
    "k_smooth": """SELECT call_id, frame_idx, bin, least(sum(w), 1e0) AS mask FROM
       (SELECT b.call_id, b.frame_idx + dm AS frame_idx, b.bin + dk AS bin, w FROM k_bin b CROSS JOIN k_ker) JOIN k_m USING (call_id)
       WHERE bin >= 0 AND bin <= 32 AND frame_idx >= 0 AND frame_idx < m GROUP BY 1, 2, 3""",
    "k_masked": "SELECT call_id, frame_idx, bin, magnitude * coalesce(mask, 0e0) AS magnitude FROM spec LEFT JOIN k_smooth USING (call_id, frame_idx, bin)",
    "k_aud": "SELECT call_id, frame_idx, filter AS channel, sum(magnitude * w) AS magnitude FROM k_masked JOIN tri USING (bin) WHERE call_id IN (SELECT call_id FROM k_n) GROUP BY 1, 2, 3",
}


def _voice(t):
    return t.contour.withColumn("f0", X.h1_to_f0("frequency"))


@query("M10_harmonic_mask", "SELECT call_id, frame_idx, bin FROM k_bin", **MASK)
def _(t):
    return MK.harmonic_mask(_voice(t), FR.spectrum(t.waveform, SC), SR, 64, 8, 1)


@query(
    "M11_repro_kernel",
    "SELECT call_id, frame_idx, dk, dm, round(sum(magnitude * w), 6) + 0e0 AS smeared FROM spec JOIN k_ker ON dk = bin % 33 - 16 GROUP BY 1, 2, 3, 4",
    **RSPEC,
    **MASK,
)
def _(t):
    """All kernel weights applied to the spectrum."""
    axis, _ = FR.stft_axis(SR, 64)
    tf = FR.explode_frames(FR.spectrum(t.waveform, SC), axis)
    k = MK.repro_kernel(t.spark, 64, 64, 32)
    j = tf.join(F.broadcast(k), F.col("dk") == F.col("channel") % 33 - 16)
    return j.groupBy("call_id", "frame_idx", "dk", "dm").agg(r6(F.sum(F.col("magnitude") * F.col("w"))).alias("smeared"))


@query("M12_smooth_mask", "SELECT call_id, CAST(frame_idx AS INT) AS frame_idx, CAST(bin AS INT) AS bin, round(mask, 6) + 0e0 AS mask FROM k_smooth", **MASK)
def _(t):
    return rounded(MK.long_mask(MK.contour_mask(_voice(t), t.waveform, SC, 8, 1)))


@query("M13_masked_spectrogram", "SELECT call_id, frame_idx, bin, round(magnitude, 6) + 0e0 AS magnitude FROM k_masked", **RSPEC, **MASK)
def _(t):
    return grid_rows(MK.masked_spectrogram(t.waveform, _voice(t), SC, 8, 1)[0])


@query(
    "M14_masked_aud_spectrogram",
    "SELECT call_id, frame_idx, channel, round(magnitude, 6) + 0e0 AS magnitude FROM k_aud",
    **RSPEC,
    **MASK,
    **tri_ctes("elelog", False),
)
def _(t):
    return _channel_rows(MK.masked_aud_spectrogram(t.waveform, _voice(t), SC, 8, 1))


@query("M15_masked_cepstra", _CEP, **RSPEC, **MASK, **tri_ctes("elelog", False), **cep_ctes("k_aud", True))
def _(t):
    return _channel_rows(MK.masked_cepstra(t.waveform, _voice(t), SC, 6, True, 8, 1))


@query(
    "M16_resample",
    """SELECT call_id, CAST(m AS INT) AS n, round(sum(x * w), 6) + 0e0 AS x FROM (SELECT z.call_id, m, s.x,
     8e-1 * CASE WHEN d = 0 THEN 1e0 ELSE sin(pi() * 8e-1 * d) / (pi() * 8e-1 * d) END * (5e-1 + 5e-1 * cos(pi() * least(greatest(d / 8e0, -1e0), 1e0))) AS w FROM
     (SELECT call_id, m, CAST(floor(m * 5 / 4e0) AS BIGINT) + o AS i, o - ((m * 5) % 4) / 4e0 AS d FROM (SELECT call_id, count(*) AS total FROM sample GROUP BY 1)
       CROSS JOIN (SELECT range AS m FROM range(4000)) CROSS JOIN (SELECT range - 7 AS o FROM range(16)) WHERE m < ceil(total * 8e2 / 1e3)) z
     JOIN sample s ON s.call_id = z.call_id AND s.n = z.i) GROUP BY 1, 2""",
)
def _(t):
    return FR.to_samples(FR.resample(t.waveform, SR, 800, 8)).select("call_id", "n", r6("x").alias("x"))


# ---------------------------------------------------------------- trackers from waveforms

RC = TR.RidgeConfig(f1_min=22.5, f1_max=90.0, max_jump=12.0)
_ROWS = "SELECT call_id, frame_idx, round(time, 6) AS time, round(frequency, 6) + 0e0 AS frequency, round(confidence, 6) + 0e0 AS confidence, round(peak, 6) + 0e0 AS peak FROM ridge_rows"
_HP = f"1e0 / (1e0 + pow(tan(pi() * 1125e-2 / 1e3) / tan(pi() * bin * {1000 / 256!r}::DOUBLE / 1e3), 1e1))"


@query(
    "P4_track_stft",
    _ROWS,
    sgrid=f"SELECT call_id, frame_idx, bin - 6 AS channel, bin * 1e3 / 256 AS freq_hz, magnitude * {_HP} AS magnitude, frame_idx * 64 / 1e3 AS time FROM spec",
    **spectrum_ctes("spec", 256, 64, 256, 6, 23),
    **track_ctes("sgrid", "SELECT range AS channel, (range + 6) * 1e3 / 256 AS hz FROM range(18)", "22.5e0", "9e1", "12e0"),
)
def _(t):
    return rounded(TR.track_stft(t.waveform, SR, 256, 256, 0.064, RC))


_FB_TRACK = TR.RidgeConfig(f1_min=20.0, f1_max=300.0, max_jump=120.0)


@query(
    "P4_track_fb",
    _ROWS,
    fgrid="SELECT call_id, frame_idx, channel, fc AS freq_hz, sqrt(re * re + im * im) AS magnitude, frame_idx * 32 / 1e3 AS time FROM f_co JOIN f_ch USING (channel)",
    **coeff_ctes(False),
    **track_ctes("fgrid", "SELECT channel, fc AS hz FROM f_ch", "2e1", "3e2", "12e1"),
)
def _(t):
    return rounded(TR.track_fb(t.waveform, FBC, _FB_TRACK))


@query(
    "P18_fill_and_track",
    _ROWS,
    fgrid="SELECT call_id, frame_idx, channel, fc AS freq_hz, sqrt(re * re + im * im) AS magnitude, frame_idx * 32 / 1e3 AS time FROM f_co JOIN f_ch USING (channel)",
    **coeff_ctes(False),
    **track_ctes("fgrid", "SELECT channel, fc AS hz FROM f_ch", "2e1", "3e2", "12e1"),
)
def _(t):
    """A store that holds every other call is filled, then all calls are tracked from it."""
    store = scratch_table(t.spark, "grids")
    J.fill_fb_store(t.spark, t.waveform.filter("call_id % 2 = 0"), store, FBC)
    return rounded(J.extract_from_store(t.spark, t.waveform, store, FBC, _FB_TRACK))


@query(
    "P18_extract_contours",
    "SELECT call_id, frame_idx, round(time, 6) AS time, round(frequency, 6) + 0e0 AS frequency, round(confidence, 6) + 0e0 AS confidence FROM ridge_rows",
    fgrid="SELECT call_id, frame_idx, channel, fc AS freq_hz, sqrt(re * re + im * im) AS magnitude, frame_idx * 32 / 1e3 AS time FROM f_co JOIN f_ch USING (channel)",
    **coeff_ctes(False),
    **track_ctes("fgrid", "SELECT channel, fc AS hz FROM f_ch", "2e1", "3e2", "12e1"),
)
def _(t):
    """The job's own output: half of the calls first, then the rest, from a store that the job fills."""
    sink, store = scratch_table(t.spark, "extracted"), scratch_table(t.spark, "grids")
    cfg = J.ExtractConfig(method="filterbank", sr=SR, fb=FBC, ridge=_FB_TRACK)
    J.extract_dataset(t.spark, t.waveform.filter("call_id % 2 = 0"), sink, cfg, store=store)
    J.extract_dataset(t.spark, t.waveform, sink, cfg, store=store)
    return rounded(t.spark.read.parquet(sink).drop("version"))


MRH = FR.MultiResConfig(sr=SR, hop=64, coarse_n_fft=512, coarse_win=256, fine_n_fft=512, fine_win=128, fmin=5.0, fmax=200.0)
HCFG = H.HybridConfig(
    h1_min=17.0,
    h1_max=80.0,
    candidate_step=1.0,
    proposal_jump=4.0,
    radius=3.0,
    n_harmonics=5,
    bin_radius=2,
    contrast_sigma=2.0,
    transition_scale=1.0,
    max_jump=4.0,
)
_FINE_A0, _FINE_DA = "3e0 * 1e3 / 512", "(1e3 / 512)"


def multires_hybrid_ctes() -> dict[str, str]:
    lat = lattice_ctes("fgrid", "99", f"({_FINE_A0})", _FINE_DA, 2)
    prop = proposal_ctes("cgrid", f"({_FINE_A0})", _FINE_DA)
    return {
        "v_em": "SELECT z.call_id, z.frame_idx, z.s, CASE WHEN abs(1.7e1 + z.s - c) <= 3e0 THEN round_even(z * 1e9, 0) / 1e9 ELSE -1e6 END AS x FROM z_power z JOIN q_coarse USING (call_id, frame_idx)",
        **viterbi_ctes("v_em"),
        **conf_ctes("z_power"),
        **prop,
        **lat,
        "cgrid": "SELECT call_id, frame_idx, bin - 3 AS channel, bin * 1e3 / 512 AS freq_hz, magnitude FROM crs",
        "fgrid": "SELECT call_id, frame_idx, bin - 3 AS channel, bin * 1e3 / 512 AS freq_hz, magnitude FROM fin",
        **spectrum_ctes("crs", 512, 64, 256, 3, 102),
        **spectrum_ctes("fin", 512, 64, 128, 3, 102),
    }


@query(
    "P15_track_hybrid_stft",
    """SELECT call_id, frame_idx, round(frame_idx * 64 / 1e3, 6) AS time, round(hz, 5) AS frequency, round(hz / 2e0, 5) AS f0, round(conf * pc, 5) AS confidence
   FROM c_conf JOIN q_conf USING (call_id)""",
    **multires_hybrid_ctes(),
)
def _(t):
    rows = H.contour_rows(H.track_hybrid_stft(t.waveform, MRH, HCFG))
    return rows.select(
        "call_id", "frame_idx", r6("time").alias("time"), *[r6(c, 5).alias(c) for c in ("frequency", "f0", "confidence")]
    )


_FB_HYB = FB.FilterbankConfig(kernel_size=256, num_channels=64, stride=64, f_min=5.0, f_max=200.0, sr=SR, supp_mult=0.3)


@query("P14_track_hybrid_fb")
def _(t):
    rows = H.contour_rows(H.track_hybrid_fb(t.waveform, _FB_HYB, HCFG))
    return rows.select("call_id", "frame_idx", *[r6(c, 5).alias(c) for c in ("time", "frequency", "confidence")])


