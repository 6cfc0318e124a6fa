"""Registered queries of the scalar and axis layer (F rows, naming)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import scales as S
from ..sources import stores
from .base import query, r6

LO, HI = 20.0, 60.0
ALPHA = S.ELE_ALPHA
MEL = 1000.0 / S.MEL_LOG
ELE_A = S.ELE_A

_AUD = {
    "erb": "9.2645e0 * sign({f}) * ln(1e0 + abs({f}) * 4.37e-3)",
    "mel": f"{MEL!r}::DOUBLE * sign({{f}}) * ln(1e0 + abs({{f}}) / 7e2)",
    "log10": "log10(greatest(1e0, {f}))",
    "elelog": f"log10({{f}} / {ELE_A!r}::DOUBLE + 0.88::DOUBLE) / {ALPHA!r}::DOUBLE",
}
_HZ = {
    "erb": "(exp({a} / 9.2645e0) - 1e0) / 4.37e-3",
    "mel": f"7e2 * sign({{a}}) * (exp(abs({{a}}) / {MEL!r}::DOUBLE) - 1e0)",
    "log10": "pow(1e1, {a})",
    "elelog": f"{ELE_A!r}::DOUBLE * (pow(1e1, {{a}} * {ALPHA!r}::DOUBLE) - 0.88::DOUBLE)",
}


def aud_sql(scale: str, f: str) -> str:
    return "(" + _AUD[scale].format(f=f) + ")"


def hz_sql(scale: str, a: str) -> str:
    return "(" + _HZ[scale].format(a=a) + ")"


def aud_mod_sql(scale: str, f: str, lo: float, hi: float) -> str:
    lo_s, hi_s = f"{lo!r}::DOUBLE", f"{hi!r}::DOUBLE"
    al, ah = aud_sql(scale, lo_s), aud_sql(scale, hi_s)
    sl = f"(({aud_sql(scale, f'{lo * 1.01!r}::DOUBLE')} - {al}) / {lo * 0.01!r}::DOUBLE)"
    sh = f"(({aud_sql(scale, f'{hi * 1.01!r}::DOUBLE')} - {ah}) / {hi * 0.01!r}::DOUBLE)"
    return (
        f"CASE WHEN {f} < {lo_s} THEN {sl} * ({f} - {lo_s}) + {al} "
        f"WHEN {f} > {hi_s} THEN {sh} * ({f} - {hi_s}) + {ah} ELSE {aud_sql(scale, f)} END"
    )


def hz_mod_sql(scale: str, a: str, lo: float, hi: float) -> str:
    lo_s, hi_s = f"{lo!r}::DOUBLE", f"{hi!r}::DOUBLE"
    al, ah = aud_sql(scale, lo_s), aud_sql(scale, hi_s)
    sl = f"(({aud_sql(scale, f'{lo * 1.01!r}::DOUBLE')} - {al}) / {lo * 0.01!r}::DOUBLE)"
    sh = f"(({aud_sql(scale, f'{hi * 1.01!r}::DOUBLE')} - {ah}) / {hi * 0.01!r}::DOUBLE)"
    return (
        f"CASE WHEN {a} < {al} THEN ({a} - {al}) / {sl} + {lo_s} "
        f"WHEN {a} > {ah} THEN ({a} - {ah}) / {sh} + {hi_s} ELSE {hz_sql(scale, a)} END"
    )


@query(
    "F1_hz_to_aud",
    "SELECT call_id, frame_idx, "
    + ", ".join(f"round({aud_sql(s, 'frequency')}, 6) + 0e0 AS {s}" for s in S.SCALES)
    + " FROM contour",
)
def _(t):
    return t.contour.select("call_id", "frame_idx", *[r6(S.hz_to_aud("frequency", s)).alias(s) for s in S.SCALES])


@query(
    "F2_aud_to_hz",
    "SELECT call_id, frame_idx, "
    + ", ".join(
        f"round({hz_sql(s, f'(frequency * {m})')}, 6) + 0e0 AS {s}"
        for s, m in [("erb", "1e-1"), ("mel", "2e0"), ("log10", "2e-2"), ("elelog", "1e-2")]
    )
    + " FROM contour",
)
def _(t):
    factor = {"erb": 1e-1, "mel": 2.0, "log10": 2e-2, "elelog": 1e-2}
    return t.contour.select(
        "call_id", "frame_idx", *[r6(S.aud_to_hz(F.col("frequency") * factor[s], s)).alias(s) for s in S.SCALES]
    )


@query(
    "F3_hz_to_aud_mod",
    "SELECT call_id, frame_idx, "
    + ", ".join(f"round({aud_mod_sql(s, 'frequency', LO, HI)}, 6) + 0e0 AS {s}" for s in S.SCALES)
    + " FROM contour",
)
def _(t):
    return t.contour.select(
        "call_id", "frame_idx", *[r6(S.hz_to_aud_mod("frequency", LO, HI, s)).alias(s) for s in S.SCALES]
    )


@query(
    "F4_aud_to_hz_mod",
    "SELECT call_id, frame_idx, "
    + ", ".join(
        f"round({hz_mod_sql(s, f'(frequency * {m})', LO, HI)}, 6) + 0e0 AS {s}"
        for s, m in [("erb", "4e-2"), ("mel", "2e0"), ("log10", "3e-2"), ("elelog", "1e-2")]
    )
    + " FROM contour",
)
def _(t):
    factor = {"erb": 4e-2, "mel": 2.0, "log10": 3e-2, "elelog": 1e-2}
    return t.contour.select(
        "call_id",
        "frame_idx",
        *[r6(S.aud_to_hz_mod(F.col("frequency") * factor[s], LO, HI, s)).alias(s) for s in S.SCALES],
    )


@query(
    "F5_aud_axis",
    f"""SELECT a.channel, round(a.freq_hz, 6) + 0e0 AS freq_hz, count(c.call_id) AS points FROM
  (SELECT CAST(range AS INT) AS channel, CASE WHEN range = 31 THEN 80e0 WHEN range = 0 THEN 17e0 ELSE
     {hz_sql("elelog", f"({aud_sql('elelog', '17e0')} + ({aud_sql('elelog', '80e0')} - {aud_sql('elelog', '17e0')}) * range / 31e0)")} END AS freq_hz
   FROM range(32)) a
  LEFT JOIN contour c ON c.frequency >= 17e0 AND c.frequency <= 80e0 AND a.channel =
    CAST(floor(({aud_sql("elelog", "c.frequency")} - {aud_sql("elelog", "17e0")}) / ({aud_sql("elelog", "80e0")} - {aud_sql("elelog", "17e0")}) * 31e0) AS INT)
  GROUP BY 1, 2""",
)
def _(t):
    """Axis table with the number of contour points per axis interval."""
    axis = S.aud_axis(t.spark, 17.0, 80.0, 32, "elelog")
    a0, a1 = S.hz_to_aud(17.0, "elelog"), S.hz_to_aud(80.0, "elelog")
    slot = F.floor((S.hz_to_aud("frequency", "elelog") - a0) / (a1 - a0) * 31.0).cast("int")
    inside = t.contour.filter(F.col("frequency").between(17.0, 80.0))
    hits = inside.groupBy(slot.alias("channel")).agg(F.count(F.lit(1)).alias("n"))
    return axis.join(F.broadcast(hits), "channel", "left").select(
        "channel", r6("freq_hz").alias("freq_hz"), F.coalesce("n", F.lit(0)).alias("points")
    )


@query(
    "F6_critical_bandwidth",
    f"""SELECT call_id, frame_idx, round(24.7e0 + frequency / 9.265e0, 6) + 0e0 AS erb, round(7e2 + frequency, 6) * 0e0 +
  round({math.log10(17 / 7)!r}::DOUBLE * (7e2 + frequency) / 1e3, 6) AS mel, frequency AS log10,
  round((frequency + 2e1 - 24.7e0) * 9.265e0, 6) + 0e0 AS erb_fc, round(1e3 * frequency / {math.log10(17 / 7)!r}::DOUBLE - 7e2, 6) + 0e0 AS mel_fc
  FROM contour""",
)
def _(t):
    return t.contour.select(
        "call_id",
        "frame_idx",
        r6(S.fc_to_bw("frequency", "erb")).alias("erb"),
        r6(S.fc_to_bw("frequency", "mel")).alias("mel"),
        S.fc_to_bw("frequency", "log10").alias("log10"),
        r6(S.bw_to_fc(F.col("frequency") + 20.0, "erb")).alias("erb_fc"),
        r6(S.bw_to_fc("frequency", "mel")).alias("mel_fc"),
    )


@query(
    "F7_h1_f0",
    "SELECT call_id, frame_idx, frequency / 2e0 AS f0, frequency * 2e0 AS doubled FROM contour",
)
def _(t):
    return t.contour.select(
        "call_id", "frame_idx", X.h1_to_f0("frequency").alias("f0"), X.f0_to_h1("frequency").alias("doubled")
    )


@query(
    "F8_to_db",
    """SELECT call_id, frame_idx, channel, round(greatest(2e1 * log10(greatest(magnitude, 1e-5)) - 2e1 * log10(p), -8e1), 6) + 0e0 AS db
  FROM (SELECT *, greatest(max(magnitude) OVER (PARTITION BY call_id), 1e-5) AS p FROM tf)""",
)
def _(t):
    return X.to_db(t.tf).select("call_id", "frame_idx", "channel", r6("db").alias("db"))


@query(
    "F9_log_mag",
    """SELECT call_id, frame_idx, channel, round(ln(magnitude + 1e-10), 6) + 0e0 AS eps_log,
  round(ln(greatest(magnitude, coalesce(med * 1e-6, 1e-12))), 6) + 0e0 AS floored_log
  FROM tf JOIN (SELECT call_id, quantile_cont(magnitude, 5e-1) AS med FROM tf WHERE magnitude > 0 GROUP BY 1) USING (call_id)""",
)
def _(t):
    both = X.log_mag(X.log_mag(t.tf, "eps").withColumnRenamed("log_mag", "eps_log"), "floored")
    return both.select(
        "call_id", "frame_idx", "channel", r6("eps_log").alias("eps_log"), r6("log_mag").alias("floored_log")
    )


@query(
    "F10_power",
    "SELECT call_id, frame_idx, channel, round(pow(abs(magnitude), 2e0), 6) + 0e0 AS power FROM tf",
)
def _(t):
    return X.power(t.tf, 2.0).select("call_id", "frame_idx", "channel", r6("power").alias("power"))


@query(
    "F11_band",
    "SELECT call_id, frame_idx, channel, round(freq_hz, 6) AS freq_hz, magnitude FROM tf WHERE freq_hz >= 22.5e0 AND freq_hz <= 5e1",
)
def _(t):
    return X.band(t.tf, 22.5, 50.0).select(
        "call_id", "frame_idx", "channel", r6("freq_hz").alias("freq_hz"), "magnitude"
    )


@query(
    "F12_voiced",
    "SELECT call_id, frame_idx, frequency > 0 AS voiced, frequency > 2.5e1 AS voiced_25 FROM contour",
)
def _(t):
    return t.contour.select(
        "call_id", "frame_idx", X.voiced("frequency").alias("voiced"), X.voiced("frequency", 25.0).alias("voiced_25")
    )


@query(
    "F13_harmonics",
    """SELECT call_id, frame_idx, CAST(k AS INT) AS k, round(k * frequency / 2e0, 6) + 0e0 AS harmonic_hz
  FROM contour, (SELECT range AS k FROM range(1, 13)) WHERE k * frequency / 2e0 > 0 AND k * frequency / 2e0 <= 25e1""",
)
def _(t):
    c = t.contour.withColumn("f0", X.h1_to_f0("frequency"))
    return X.harmonics(c, 12, 250.0).select("call_id", "frame_idx", "k", r6("harmonic_hz").alias("harmonic_hz"))


@query(
    "F14_harmonic_weight",
    """SELECT call_id, round(sum(pow(k, -35e-2) * frequency), 6) + 0e0 AS weighted
  FROM contour, (SELECT range AS k FROM range(1, 13)) WHERE k * frequency / 2e0 > 0 AND k * frequency / 2e0 <= 25e1 GROUP BY 1""",
)
def _(t):
    c = t.contour.withColumn("f0", X.h1_to_f0("frequency"))
    w = X.harm_weight("k", 0.35) * F.col("frequency")
    return X.harmonics(c, 12, 250.0).groupBy("call_id").agg(r6(F.sum(w)).alias("weighted"))


@query(
    "F15_quad_offset",
    """SELECT call_id, frame_idx, channel, CASE WHEN abs(l - 2e0 * m + r) > 1e-12 THEN
    round(least(greatest(5e-1 * (l - r) / (l - 2e0 * m + r), -1e0), 1e0), 6) + 0e0 ELSE 0e0 END AS wide,
  CASE WHEN abs(l - 2e0 * m + r) > 1e-12 THEN
    round(least(greatest(5e-1 * (l - r) / (l - 2e0 * m + r), -75e-2), 75e-2), 6) + 0e0 ELSE 0e0 END AS narrow
  FROM (SELECT call_id, frame_idx, channel, magnitude AS m, lag(magnitude) OVER w AS l, lead(magnitude) OVER w AS r
        FROM tf WINDOW w AS (PARTITION BY call_id, frame_idx ORDER BY channel))
  WHERE l IS NOT NULL AND r IS NOT NULL""",
)
def _(t):
    triples = t.tf_frame.select(
        "call_id",
        "frame_idx",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("mags") - 2),
                lambda i: F.struct(
                    i.alias("channel"),
                    F.get("mags", i - 1).alias("l"),
                    F.get("mags", i).alias("m"),
                    F.get("mags", i + 1).alias("r"),
                ),
            )
        ).alias("p"),
    )
    off = lambda lim: r6(X.quad_offset(F.col("p.l"), F.col("p.m"), F.col("p.r"), lim))
    return triples.select(
        "call_id", "frame_idx", F.col("p.channel").alias("channel"), off(1.0).alias("wide"), off(0.75).alias("narrow")
    )


@query(
    "F16_sigmoid_margin",
    """SELECT call_id, frame_idx, round(1e0 / (1e0 + exp(-least(greatest(a.frequency - b.frequency, -12e0), 12e0))), 6) AS conf
  FROM contour a JOIN contour_ref b USING (call_id, frame_idx)""",
)
def _(t):
    j = t.contour.alias("a").join(t.contour_ref.alias("b"), ["call_id", "frame_idx"])
    return j.select(
        "call_id", "frame_idx", r6(X.sigmoid_margin(F.col("a.frequency"), F.col("b.frequency"))).alias("conf")
    )


@query(
    "F17_zscore",
    """SELECT call_id, frame_idx, CASE WHEN s > 0 THEN round((frequency - m) / s, 6) + 0e0 ELSE 0e0 END AS z FROM
  (SELECT call_id, frame_idx, frequency, avg(frequency) OVER (PARTITION BY call_id) AS m,
          stddev_pop(frequency) OVER (PARTITION BY call_id) AS s FROM contour)""",
)
def _(t):
    return X.zscore(t.contour, "frequency").select("call_id", "frame_idx", r6("z").alias("z"))


@query(
    "F18_highpass_gain",
    """SELECT call_id, frame_idx, channel,
  round(magnitude / (1e0 + pow(tan(pi() * 25e0 / 1e3) / tan(pi() * freq_hz / 1e3), 1e1)), 6) + 0e0 AS magnitude FROM tf""",
)
def _(t):
    gain = X.highpass_gain("freq_hz", 25.0, 1000.0, 5)
    return t.tf.select("call_id", "frame_idx", "channel", r6(F.col("magnitude") * gain).alias("magnitude"))


_HANN_P = "(5e-1 - 5e-1 * cos(2e0 * pi() * (n % 64) / 64e0))"
_HANN_S = "(CASE WHEN n % 64 >= 8 AND n % 64 < 56 THEN (5e-1 - 5e-1 * cos(2e0 * pi() * (n % 64 - 8) / 47e0)) / 235e-1 ELSE 0e0 END)"


def _blocks(t, win):
    """Samples joined with a window table by position inside 64-sample blocks."""
    s = t.sample.withColumn("block", F.floor(F.col("n") / 64).cast("int"))
    return s.join(F.broadcast(win.withColumnRenamed("n", "k")), F.col("n") % 64 == F.col("k"))


@query(
    "F19_hann",
    f"""SELECT call_id, CAST(floor(n / 64e0) AS INT) AS block, round(sum(x * {_HANN_P}), 6) + 0e0 AS periodic,
  round(sum(x * {_HANN_S}), 6) + 0e0 AS symmetric FROM sample GROUP BY 1, 2""",
)
def _(t):
    win = S.hann(t.spark, 64, periodic=True).withColumnRenamed("w", "wp").join(
        S.hann(t.spark, 48, padto=64).withColumnRenamed("w", "ws"), "n"
    )
    return (
        _blocks(t, win)
        .groupBy("call_id", "block")
        .agg(
            r6(F.sum(F.col("x") * F.col("wp"))).alias("periodic"),
            r6(F.sum(F.col("x") * F.col("ws"))).alias("symmetric"),
        )
    )


@query(
    "F20_modulate",
    f"""SELECT call_id, CAST(floor(n / 64e0) AS INT) AS block,
  round(sum(x * {_HANN_P} * cos(2e0 * pi() * 3e1 * (n % 64) / 1e3)), 6) + 0e0 AS re,
  round(sum(x * {_HANN_P} * sin(2e0 * pi() * 3e1 * (n % 64) / 1e3)), 6) + 0e0 AS im FROM sample GROUP BY 1, 2""",
)
def _(t):
    win = S.modulate(S.hann(t.spark, 64, periodic=True), 30.0, 1000.0)
    return (
        _blocks(t, win)
        .groupBy("call_id", "block")
        .agg(r6(F.sum(F.col("x") * F.col("re"))).alias("re"), r6(F.sum(F.col("x") * F.col("im"))).alias("im"))
    )


@query(
    "F21_dual_window",
    """SELECT call_id, CAST(floor(n / 64e0) AS INT) AS block, round(sum(x * dual), 6) + 0e0 AS projected
  FROM sample JOIN (SELECT k, w / greatest(sum(w * w) OVER (PARTITION BY k % 16), 1e-8) AS dual FROM
    (SELECT range AS k, 5e-1 - 5e-1 * cos(2e0 * pi() * range / 64e0) AS w FROM range(64))) ON n % 64 = k GROUP BY 1, 2""",
)
def _(t):
    win = S.dual_window(S.hann(t.spark, 64, periodic=True), 16)
    return _blocks(t, win).groupBy("call_id", "block").agg(r6(F.sum(F.col("x") * F.col("dual"))).alias("projected"))


@query(
    "F22_frame_time",
    """SELECT call_id, frame_idx, round(frame_idx * 256 / 16e3, 6) AS frame_s,
  CAST(greatest(least(round_even(time * 16e3 / 320, 0), 29), 0) AS INT) AS frame FROM contour""",
)
def _(t):
    return t.contour.select(
        "call_id",
        "frame_idx",
        r6(X.frame_time("frame_idx", 256, 16000.0)).alias("frame_s"),
        X.time_frame("time", 320, 16000.0, 30).alias("frame"),
    )


@query(
    "F23_pixel_masks",
    """SELECT y, count(*) AS pixels, count(*) FILTER (WHERE b >= 70 AND b - r >= 20 AND b - g >= 7
      AND greatest(r, g, b) - least(r, g, b) >= 20) AS blue,
    count(*) FILTER (WHERE 2126e-4 * r + 7152e-4 * g + 722e-4 * b < 135e0 AND NOT
      (b - r > 10 AND b - g > 2 AND 2126e-4 * r + 7152e-4 * g + 722e-4 * b >= 82e0)) AS ink
  FROM (SELECT y, trace_id * 7 % 256 AS r, x * 3 % 256 AS g, (x + y * 2) % 256 AS b FROM trace_pixels) GROUP BY 1""",
)
def _(t):
    px = t.trace_pixels.select(
        "y",
        (F.col("trace_id") * 7 % 256).alias("r"),
        (F.col("x") * 3 % 256).alias("g"),
        ((F.col("x") + F.col("y") * 2) % 256).alias("b"),
    )
    return px.groupBy("y").agg(
        F.count(F.lit(1)).alias("pixels"),
        F.count_if(X.blue_mask("r", "g", "b")).alias("blue"),
        F.count_if(X.ink_mask("r", "g", "b")).alias("ink"),
    )


@query(
    "S14_version_names",
    """SELECT event_type, props, CASE WHEN v = '' THEN 'peak' ELSE v END AS version, 'f0_' || CASE WHEN v = '' THEN 'peak' ELSE v END AS folder,
  'stft_' || replace(CASE WHEN f = floor(f) THEN CAST(CAST(f AS BIGINT) AS VARCHAR) ELSE CAST(f AS VARCHAR) END, '.', 'p') AS store
  FROM (SELECT DISTINCT event_type, props, CASE WHEN event_type = 'error' THEN '' ELSE replace(lower(trim('  ' || upper(event_type) || '-V1 ')), '-', '_') END AS v,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) / 2e0 AS f FROM events)""",
)
def _(t):
    ev = t.raw("events").select("event_type", "props").distinct()
    label = F.when(F.col("event_type") == "error", F.lit("  ")).otherwise(
        F.concat(F.lit("  "), F.upper("event_type"), F.lit("-V1 "))
    )
    fmax = F.get_json_object("props", "$.k").cast("double") / 2.0
    return ev.select(
        "event_type",
        "props",
        stores.norm_version(label).alias("version"),
        stores.version_folder(label).alias("folder"),
        stores.store_name("stft", fmax).alias("store"),
    )
