"""Registered queries of contour editing and clustering (C, K, A16, A17 rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as K
from ..operators import edit as E
from ..operators import stats as ST
from ..sources import stores as SO
from .base import query, r6
from .q_stats import rounded

BOUNDS = """SELECT call_id, max(CASE WHEN frame_idx = 30 THEN time END) AS start_s, max(CASE WHEN frame_idx = 8 THEN time END) AS end_s FROM contour GROUP BY 1"""


def bounds_of(t):
    """Reversed on purpose: start at frame 30, end at frame 8."""
    at = lambda k: F.max(F.when(F.col("frame_idx") == k, F.col("time")))
    return t.contour.groupBy("call_id").agg(at(30).alias("start_s"), at(8).alias("end_s"))


FEW = {
    "pt": "SELECT call_id, time, avg(freq) AS freq FROM correction GROUP BY 1, 2",
    "pn": "SELECT call_id, count(*) AS k, min(time) AS t0, max(time) AS t1, any_value(freq) AS f1 FROM pt GROUP BY 1",
}


@query(
    "C1_apply_corrections_linear",
    """SELECT call_id, frame_idx, round(greatest(least(f, 45e0), 0e0), 6) + 0e0 AS frequency FROM
  (SELECT c.call_id, c.frame_idx, CASE WHEN n.k = 1 THEN CASE WHEN abs(c.time - n.t0) < 5e-1 THEN n.f1 ELSE c.frequency END
    WHEN n.k IN (2, 3) AND c.time >= n.t0 AND c.time <= n.t1 THEN l.freq + CASE WHEN r.time > l.time THEN (r.freq - l.freq) * ((c.time - l.time) / (r.time - l.time)) ELSE 0e0 END
    ELSE c.frequency END AS f
   FROM contour c LEFT JOIN pn n USING (call_id)
   LEFT JOIN pt l ON l.call_id = c.call_id AND l.time = (SELECT max(p.time) FROM pt p WHERE p.call_id = c.call_id AND p.time <= c.time)
   LEFT JOIN pt r ON r.call_id = c.call_id AND r.time = coalesce((SELECT min(p.time) FROM pt p WHERE p.call_id = c.call_id AND p.time > c.time), n.t1)
   WHERE coalesce(n.k, 0) < 4)""",
    **FEW,
)
def _(t):
    few = E.dedupe_times(t.correction).groupBy("call_id").agg(F.count(F.lit(1)).alias("k")).filter("k >= 4")
    c = t.contour.join(few, "call_id", "left_anti")
    out = E.apply_corrections(c, t.correction.join(few, "call_id", "left_anti"), 45.0)
    return out.select("call_id", "frame_idx", r6("frequency").alias("frequency"))


# Not-a-knot curvatures of all calls at once: elimination forward, substitution back, then the two ends.
SPLINE = {
    **FEW,
    "base": f"""SELECT call_id, frame_idx, time, CASE WHEN start_s IS NOT NULL AND end_s IS NOT NULL AND (time < least(start_s, end_s) OR time > greatest(start_s, end_s))
   THEN 0e0 ELSE frequency END AS frequency FROM contour JOIN ({BOUNDS}) USING (call_id)""",
    "gap": """SELECT call_id, k, row_number() OVER w - 1 AS i, time AS x, freq AS y, lead(time) OVER w AS nx, lead(freq) OVER w AS ny
  FROM pt JOIN pn USING (call_id) WHERE k >= 4 WINDOW w AS (PARTITION BY call_id ORDER BY time)""",
    "eq": """SELECT call_id, k, i, p, q, CASE WHEN i = k - 2 THEN (p * p - q * q) / p ELSE p END AS lo,
   CASE WHEN i = 1 THEN (p + q) * (p + 2 * q) / q WHEN i = k - 2 THEN (p + q) * (2 * p + q) / p ELSE 2 * (p + q) END AS di,
   CASE WHEN i = 1 THEN (q * q - p * p) / q ELSE q END AS up, 6 * (m - pm) AS rhs
  FROM (SELECT call_id, k, i, lag(nx - x) OVER w AS p, nx - x AS q, lag((ny - y) / (nx - x)) OVER w AS pm, (ny - y) / (nx - x) AS m
   FROM gap WINDOW w AS (PARTITION BY call_id ORDER BY i)) WHERE i BETWEEN 1 AND k - 2""",
    "fwd": """SELECT call_id, i, up / di AS cp, rhs / di AS dp FROM eq WHERE i = 1
  UNION ALL SELECT e.call_id, e.i, e.up / (e.di - e.lo * f.cp), (e.rhs - e.lo * f.dp) / (e.di - e.lo * f.cp)
  FROM fwd f JOIN eq e ON e.call_id = f.call_id AND e.i = f.i + 1""",
    "steps": "SELECT f.*, n.k FROM fwd f JOIN pn n USING (call_id)",
    "bwd": """SELECT call_id, i, dp AS s FROM steps WHERE i = k - 2
  UNION ALL SELECT f.call_id, f.i, f.dp - f.cp * b.s FROM bwd b JOIN steps f ON f.call_id = b.call_id AND f.i = b.i - 1""",
    "inner_s": "SELECT * FROM bwd",
    "curv": """SELECT * FROM inner_s
  UNION ALL SELECT e.call_id, 0, ((e.p + e.q) * a.s - e.p * b.s) / e.q FROM eq e JOIN inner_s a ON a.call_id = e.call_id AND a.i = 1
   JOIN inner_s b ON b.call_id = e.call_id AND b.i = 2 WHERE e.i = 1
  UNION ALL SELECT e.call_id, e.k - 1, ((e.p + e.q) * a.s - e.q * b.s) / e.p FROM eq e JOIN inner_s a ON a.call_id = e.call_id AND a.i = e.k - 2
   JOIN inner_s b ON b.call_id = e.call_id AND b.i = e.k - 3 WHERE e.i = e.k - 2""",
    "seg": """SELECT g.call_id, g.x, g.nx, g.nx - g.x AS h, g.y, g.ny, a.s, b.s AS ns, g.i = g.k - 2 AS is_last FROM gap g
   JOIN curv a ON a.call_id = g.call_id AND a.i = g.i JOIN curv b ON b.call_id = g.call_id AND b.i = g.i + 1 WHERE g.i <= g.k - 2""",
}


@query(
    "C1_apply_corrections",
    """SELECT call_id, frame_idx, round(greatest(least(f, 45e0), 0e0), 6) + 0e0 AS frequency FROM
  (SELECT c.call_id, c.frame_idx, CASE
    WHEN g.h IS NOT NULL THEN (g.s * pow(g.nx - c.time, 3) + g.ns * pow(c.time - g.x, 3)) / (6 * g.h)
      + (g.y / g.h - g.s * g.h / 6) * (g.nx - c.time) + (g.ny / g.h - g.ns * g.h / 6) * (c.time - g.x)
    WHEN n.k = 1 THEN CASE WHEN abs(c.time - n.t0) < 5e-1 THEN n.f1 ELSE c.frequency END
    WHEN n.k IN (2, 3) AND c.time >= n.t0 AND c.time <= n.t1 THEN l.freq + CASE WHEN r.time > l.time THEN (r.freq - l.freq) * ((c.time - l.time) / (r.time - l.time)) ELSE 0e0 END
    ELSE c.frequency END AS f
   FROM base c LEFT JOIN pn n USING (call_id)
   LEFT JOIN seg g ON g.call_id = c.call_id AND c.time >= g.x AND (c.time < g.nx OR g.is_last AND c.time <= g.nx)
   LEFT JOIN pt l ON l.call_id = c.call_id AND n.k < 4 AND l.time = (SELECT max(p.time) FROM pt p WHERE p.call_id = c.call_id AND p.time <= c.time)
   LEFT JOIN pt r ON r.call_id = c.call_id AND n.k < 4 AND r.time = coalesce((SELECT min(p.time) FROM pt p WHERE p.call_id = c.call_id AND p.time > c.time), n.t1))""",
    **SPLINE,
)
def _(t):
    """All calls: constants, lines and cubic splines."""
    out = E.apply_corrections(t.contour, t.correction, 45.0, bounds_of(t))
    return out.select("call_id", "frame_idx", r6("frequency").alias("frequency"))


@query(
    "C2_zero_outside",
    f"""SELECT call_id, frame_idx, CASE WHEN start_s IS NOT NULL AND end_s IS NOT NULL AND (time < least(start_s, end_s) OR time > greatest(start_s, end_s))
   THEN 0e0 ELSE frequency END AS frequency FROM contour JOIN ({BOUNDS}) USING (call_id)""",
)
def _(t):
    return E.zero_outside(t.contour, bounds_of(t)).select("call_id", "frame_idx", "frequency")


@query(
    "C3_assign_markers",
    """SELECT c.call_id, c.frame_idx, CAST(coalesce(c.frame_idx = s, false) AS INT) AS start_point, CAST(coalesce(c.frame_idx = e, false) AS INT) AS end_point
  FROM contour c JOIN (SELECT call_id, coalesce(arg_min(frame_idx, (abs(time - b.t), frame_idx)) FILTER (WHERE b.t IS NOT NULL), min(frame_idx) FILTER (WHERE frequency > 0)) AS s,
     max(frame_idx) FILTER (WHERE frequency > 0) AS e FROM contour LEFT JOIN (SELECT call_id, min(time) + 5e-3 AS t FROM correction GROUP BY 1) b USING (call_id) GROUP BY 1) USING (call_id)""",
)
def _(t):
    """Start near the first correction point where there is one; the end is the last voiced frame."""
    b = t.correction.groupBy("call_id").agg((F.min("time") + 5e-3).alias("start_s"))
    b = b.withColumn("end_s", F.lit(None).cast("double"))
    return E.assign_markers(t.contour, b).select("call_id", "frame_idx", "start_point", "end_point")


_FLAGS = """SELECT call_id, CAST(bool_or(kind = 'error') AS INT) AS overlapping, CAST(max(v) < 15e1 AS INT) AS bad, CAST(max(v) > 3e2 AS INT) AS awesome FROM ev GROUP BY 1 HAVING count(*) > 45"""


@query(
    "C4_set_flags",
    f"""SELECT call_id, frame_idx, coalesce(overlapping, 0) AS overlapping, coalesce(bad, 0) AS bad, coalesce(awesome, 0) AS awesome
   FROM contour LEFT JOIN flag USING (call_id)""",
    flag=_FLAGS,
)
def _(t):
    f = t.event_frames.groupBy("call_id").agg(
        F.bool_or(F.col("kind") == "error").alias("overlapping"),
        (F.max("v") < 150).alias("bad"),
        (F.max("v") > 300).alias("awesome"),
        F.count(F.lit(1)).alias("n"),
    ).filter("n > 45")
    return E.set_flags(t.contour, f).select("call_id", "frame_idx", *E.FLAGS)


@query(
    "C4_read_flags",
    """SELECT DISTINCT call_id, coalesce(overlapping, 0) AS overlapping, coalesce(bad, 0) AS bad, 0 AS awesome FROM ev LEFT JOIN flag USING (call_id)""",
    flag=_FLAGS,
)
def _(t):
    f = t.event_frames.groupBy("call_id").agg(
        F.bool_or(F.col("kind") == "error").alias("overlapping"),
        (F.max("v") < 150).alias("bad"),
        F.lit(True).alias("awesome"),
        F.count(F.lit(1)).alias("n"),
    ).filter("n > 45")
    return E.read_flags(E.set_flags(t.contour, f).drop("awesome"))


@query(
    "C5_realign",
    """SELECT c.call_id, c.frame_idx, round(c.time - a.time, 6) + 0e0 AS time, c.frequency FROM contour_ref c
   JOIN (SELECT call_id, min(frame_idx) FILTER (WHERE start_point = 1) AS s, max(frame_idx) FILTER (WHERE end_point = 1) AS e FROM contour_ref GROUP BY 1
      HAVING bool_or(start_point = 1) AND bool_or(end_point = 1)) m USING (call_id)
   JOIN contour_ref a ON a.call_id = c.call_id AND a.frame_idx = least(s, e) WHERE c.frame_idx BETWEEN least(s, e) AND greatest(s, e)""",
)
def _(t):
    return E.realign(t.contour_ref).select("call_id", "frame_idx", r6("time").alias("time"), "frequency")


@query(
    "C6_trim",
    """SELECT c.call_id, c.frame_idx, round(c.time - lo, 6) + 0e0 AS time, c.frequency FROM contour_ref c
   JOIN (SELECT call_id, least(min(time) FILTER (WHERE start_point = 1), min(time) FILTER (WHERE end_point = 1)) AS lo,
      greatest(min(time) FILTER (WHERE start_point = 1), min(time) FILTER (WHERE end_point = 1)) AS hi,
      bool_or(start_point = 1) AND bool_or(end_point = 1) AS ok FROM contour_ref GROUP BY 1) USING (call_id) WHERE ok AND c.time BETWEEN lo AND hi""",
)
def _(t):
    return E.trim(t.contour_ref)[0].select("call_id", "frame_idx", r6("time").alias("time"), "frequency")


@query(
    "C6_trim_samples",
    """SELECT call_id, count(*) AS n, round(sum(x), 6) + 0e0 AS total FROM sample JOIN
   (SELECT call_id, least(min(time) FILTER (WHERE start_point = 1), min(time) FILTER (WHERE end_point = 1)) AS lo,
      greatest(min(time) FILTER (WHERE start_point = 1), min(time) FILTER (WHERE end_point = 1)) AS hi FROM contour_ref GROUP BY 1
      HAVING bool_or(start_point = 1) AND bool_or(end_point = 1)) USING (call_id)
   WHERE n >= floor(lo * 1e3) AND n < floor(hi * 1e3) GROUP BY 1""",
)
def _(t):
    _, wf = E.trim(t.contour_ref, t.waveform)
    s = wf.select("call_id", F.explode("samples").alias("x"))
    return s.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("x")).alias("total"))


# lengths: 0.3 s per frame over the call, so that some calls stretch
TS = {
    "ts_info": """SELECT call_id, CASE WHEN ok THEN s ELSE 0e0 END AS start_s, CASE WHEN ok THEN e ELSE dur END AS end_s, CASE WHEN ok THEN sf END AS sf, CASE WHEN ok THEN ef END AS ef,
       (least(CASE WHEN ok THEN floor(e * 1e3) ELSE floor(dur * 1e3) END, floor(dur * 1e3)) - CASE WHEN ok THEN floor(s * 1e3) ELSE 0e0 END) / 1e3 AS len FROM
       (SELECT call_id, count(*) * 5e-2 AS dur, min(time) FILTER (WHERE start_point = 1) AS s, min(time) FILTER (WHERE end_point = 1) AS e,
         min(frame_idx) FILTER (WHERE start_point = 1) AS sf, min(frame_idx) FILTER (WHERE end_point = 1) AS ef,
         bool_or(start_point = 1) AND bool_or(end_point = 1) AS ok FROM contour_ref GROUP BY 1)""",
    "ts_rate": "SELECT *, len < 25e-1 AS stretched, CASE WHEN len < 25e-1 THEN len / 25e-1 ELSE 1e0 END AS rate FROM ts_info",
}


def _stretch(t):
    d = t.contour_ref.groupBy("call_id").agg((F.count(F.lit(1)) * 5e-2).alias("duration"))
    return E.trim_stretch(t.contour_ref, d.withColumn("sr", F.lit(1000)), 2.5)


@query(
    "C7_trim_stretch",
    """SELECT c.call_id, c.frame_idx, round((c.time - start_s) / rate, 6) + 0e0 AS time, c.frequency FROM contour_ref c JOIN ts_rate USING (call_id)
   WHERE sf IS NULL OR c.frame_idx BETWEEN sf AND ef""",
    **TS,
)
def _(t):
    return _stretch(t)[0].select("call_id", "frame_idx", r6("time").alias("time"), "frequency")


@query(
    "A17_trim_stats",
    """SELECT count(*) AS processed, count(*) FILTER (WHERE stretched) AS stretched, round(1e2 * count(*) FILTER (WHERE stretched) / count(*), 6) AS stretched_percent,
   round(avg(end_s - start_s), 6) AS mean_trim, round(min(end_s - start_s), 6) AS min_trim, round(max(end_s - start_s), 6) AS max_trim,
   round(avg(rate) FILTER (WHERE stretched), 6) AS mean_rate, round(min(rate) FILTER (WHERE stretched), 6) AS min_rate, round(max(rate) FILTER (WHERE stretched), 6) AS max_rate FROM ts_rate""",
    **TS,
)
def _(t):
    return rounded(ST.trim_stats(_stretch(t)[1]))


@query(
    "C8_blank_contour",
    """SELECT call_id, CAST(range AS INT) AS frame_idx, round(range * 1.6e-2, 6) AS time, 0e0 AS frequency, 1e0 AS confidence
   FROM (SELECT call_id, count(*) AS n FROM sample GROUP BY 1), range(100000) WHERE range < ceil(n / 1e3 / 1.6e-2 - 1e-9)""",
)
def _(t):
    from ..operators import lookup as L

    return rounded(L.blank_contour(t.waveform, 1.6e-2))


def trace_ctes(scale: str) -> dict[str, str]:
    pitch = "1e1 + pos * 2e1" if scale == "linear" else "1e1 * pow(3e0, pos)"
    return {
        "tr_col": "SELECT trace_id, x, quantile_cont(CAST(y AS DOUBLE), 5e-1) AS cy FROM trace_pixels GROUP BY 1, 2",
        "tr_ok": "SELECT trace_id FROM tr_col GROUP BY 1 HAVING count(*) >= 2 AND (max(x) - min(x) + 1) / 12e1 >= 55e-2",
        "tr_fill": """SELECT g.trace_id, g.x, coalesce(l.cy, r.cy) + CASE WHEN l.x IS NOT NULL AND r.x IS NOT NULL AND r.x > l.x THEN (r.cy - l.cy) * ((g.x - l.x) / CAST(r.x - l.x AS DOUBLE)) ELSE 0e0 END AS v,
            coalesce(l.x = g.x, false) AS observed
          FROM (SELECT trace_id, CAST(range AS INT) AS x, (SELECT max(c.x) FROM tr_col c WHERE c.trace_id = tr_ok.trace_id AND c.x <= range) AS lx,
             (SELECT min(c.x) FROM tr_col c WHERE c.trace_id = tr_ok.trace_id AND c.x >= range) AS rx FROM tr_ok, range(120)) g
          LEFT JOIN tr_col l ON l.trace_id = g.trace_id AND l.x = g.lx LEFT JOIN tr_col r ON r.trace_id = g.trace_id AND r.x = g.rx""",
        "tr_med": """SELECT a.trace_id, a.x, any_value(a.observed) AS observed, quantile_cont(b.v, 5e-1) AS v FROM tr_fill a CROSS JOIN (SELECT range - 2 AS o FROM range(5))
          JOIN tr_fill b ON b.trace_id = a.trace_id AND b.x = greatest(least(a.x + o, 119), 0) GROUP BY 1, 2""",
        "tr_out": f"""SELECT trace_id, x AS col, x / 119e0 AS position, {pitch} AS f0, observed FROM
          (SELECT *, least(greatest(1e0 - v / 78e0, 0e0), 1e0) AS pos FROM tr_med)""",
    }


_TRACE = "SELECT trace_id, col, round(position, 6) AS position, round(f0, 6) AS f0, observed FROM tr_out"


def _trace(t, scale):
    return E.trace_to_contour(t.trace_pixels, E.TraceConfig(scale=scale, width=120, height=79))


@query("C9_trace_to_contour", _TRACE, **trace_ctes("linear"))
def _(t):
    return rounded(_trace(t, "linear"))


@query("C9_trace_to_contour_log", _TRACE, **trace_ctes("log"))
def _(t):
    return rounded(_trace(t, "log"))


@query(
    "C10_trace_to_duration",
    """SELECT trace_id, m AS frame_idx, round(m * 5e-2, 6) AS time, round(2e0 * f, 6) AS frequency, round(f, 6) AS f0_hz, round(c, 6) + 0e0 AS confidence,
   CAST(m = 0 AS INT) AS start_point, CAST(m = n - 1 AS INT) AS end_point, 'photo_drawing' AS algorithm, 'f1' AS frequency_role FROM
  (SELECT g.trace_id, g.m, g.n, l.f0 + (r.f0 - l.f0) * (p - lo) AS f, CAST(l.observed AS INT) + (CAST(r.observed AS INT) - CAST(l.observed AS INT)) * (p - lo) AS c FROM
    (SELECT *, CAST(least(floor(p + 1e-12), 118) AS INT) AS lo FROM
      (SELECT trace_id, n, CAST(range AS INT) AS m, least(range * 5e-2 / dur, 1e0) * 119e0 AS p FROM
        (SELECT trace_id, dur, ceil(dur / 5e-2 - 1e-9) AS n FROM td) JOIN (SELECT DISTINCT trace_id FROM tr_out) USING (trace_id), range(2000) WHERE range < n)) g
    JOIN tr_out l ON l.trace_id = g.trace_id AND l.col = g.lo JOIN tr_out r ON r.trace_id = g.trace_id AND r.col = g.lo + 1)""",
    td="SELECT trace_id, 1e0 + count(*) / 1e2 AS dur FROM trace_pixels GROUP BY 1",
    **trace_ctes("linear"),
)
def _(t):
    dur = t.trace_pixels.groupBy("trace_id").agg((F.count(F.lit(1)) / 1e2 + 1.0).alias("duration"))
    return rounded(E.trace_to_duration(_trace(t, "linear"), dur, 5e-2))


@query(
    "C11_harmonic_guides",
    """SELECT call_id, version, count(*) AS points, round(sum(k * frequency / 2e0), 5) + 0e0 AS total_hz FROM
   (SELECT call_id, 'extracted' AS version, frequency FROM contour UNION ALL SELECT call_id, 'corrected', frequency FROM contour_ref), (SELECT range AS k FROM range(1, 9))
   WHERE frequency > 0 AND k * frequency / 2e0 <= 15e1 GROUP BY 1, 2""",
)
def _(t):
    v = SO.union_versions(
        t.contour.withColumn("version", F.lit("extracted")), t.contour_ref.withColumn("version", F.lit("corrected"))
    )
    g = E.harmonic_guides(v, 8, 150.0)
    return g.groupBy("call_id", "version").agg(
        F.count(F.lit(1)).alias("points"), r6(F.sum("harmonic_hz"), 5).alias("total_hz")
    )


# ---------------------------------------------------------------- clustering

POINTS = 16
CL = {
    "k_in": """SELECT call_id, frame_idx, time, frequency / 2e0 AS f0, row_number() OVER (PARTITION BY call_id ORDER BY time) - 1 AS i FROM contour
       WHERE frequency > 0 AND call_id IN (SELECT call_id FROM contour WHERE frequency > 0 GROUP BY 1 HAVING count(*) >= 2)""",
    "k_span": "SELECT call_id, min(time) AS t0, max(time) AS t1, count(*) AS n, avg(f0) AS mf, stddev_pop(f0) AS sf FROM k_in GROUP BY 1",
    "k_grid": f"SELECT call_id, CAST(range AS INT) AS pos, range / {POINTS - 1}e0 AS u, t0, t1 FROM k_span, range({POINTS})",
    "k_src": "SELECT call_id, i, (time - t0) / (t1 - t0) AS u, f0 FROM k_in JOIN k_span USING (call_id)",
    "k_br": """SELECT g.call_id, g.pos, g.u, max(s.i) AS i FROM k_grid g JOIN k_src s ON s.call_id = g.call_id AND s.u <= g.u GROUP BY 1, 2, 3""",
    "k_con": """SELECT b.call_id, b.pos, l.f0 + CASE WHEN r.u > l.u AND b.u > l.u THEN (r.f0 - l.f0) * ((b.u - l.u) / (r.u - l.u)) ELSE 0e0 END AS f
       FROM k_br b JOIN k_src l ON l.call_id = b.call_id AND l.i = b.i LEFT JOIN k_src r ON r.call_id = b.call_id AND r.i = b.i + 1""",
    "k_log": "SELECT call_id, pos, log2(greatest(f, 1e-6)) AS g FROM k_con",
    "k_shape": """SELECT call_id, pos, g, (g - avg(g) OVER w) / stddev_pop(g) OVER w AS z FROM k_log WINDOW w AS (PARTITION BY call_id)""",
    "k_mod": "SELECT *, z - coalesce(lag(z) OVER (PARTITION BY call_id ORDER BY pos), z) AS m FROM k_shape",
    "k_curv": "SELECT *, m - coalesce(lag(m) OVER (PARTITION BY call_id ORDER BY pos), m) AS c FROM k_mod",
    "k_lvl": "SELECT call_id, mf, sf, t1 - t0 AS d FROM k_span",
    "k_feat": f"""SELECT call_id, pos, z AS x FROM k_shape UNION ALL SELECT call_id, {POINTS}, mf FROM k_lvl UNION ALL SELECT call_id, {POINTS + 1}, sf FROM k_lvl UNION ALL SELECT call_id, {POINTS + 2}, d FROM k_lvl""",
    "k_std": """SELECT call_id, pos, (x - m) / CASE WHEN s > 0 THEN s ELSE 1e0 END AS x FROM k_feat JOIN (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM k_feat GROUP BY 1) USING (pos)""",
}


def _calls(t):
    return K.resample_contour(K.usable_contours(t.contour), POINTS)


def _long(df, col="features", name="x"):
    return df.select("call_id", F.posexplode(col).alias("pos", "_v")).select("call_id", "pos", r6("_v").alias(name))


@query("K1_usable_contours", "SELECT call_id, CAST(i AS INT) AS i, round(time, 6) AS time, f0 FROM k_in", **CL)
def _(t):
    z = F.posexplode(F.arrays_zip("time", "f0")).alias("i", "z")
    return K.usable_contours(t.contour).select("call_id", z).select("call_id", "i", r6("z.time").alias("time"), F.col("z.f0").alias("f0"))


@query("K2_resample_contour", "SELECT call_id, pos, round(f, 6) AS f0 FROM k_con", **CL)
def _(t):
    return _long(_calls(t), "contour", "f0")


_LVL = f"UNION ALL SELECT call_id, {POINTS}, round(%s, 6) FROM k_lvl UNION ALL SELECT call_id, {POINTS + 1}, round(%s, 6) FROM k_lvl UNION ALL SELECT call_id, {POINTS + 2}, round(d, 6) FROM k_lvl"


@query("K3_features_balanced", "SELECT call_id, pos, round(x, 6) + 0e0 AS x FROM k_feat", **CL)
def _(t):
    return _long(K.contour_features(_calls(t), "balanced"))


@query(
    "K3_features_frequency_main",
    f"""SELECT call_id, pos, round(g, 6) + 0e0 AS x FROM k_shape UNION ALL SELECT call_id, pos + {POINTS}, round(25e-2 * m, 6) + 0e0 FROM k_mod
   UNION ALL SELECT call_id, {2 * POINTS}, round(mf, 6) FROM k_lvl UNION ALL SELECT call_id, {2 * POINTS + 1}, round(sf, 6) FROM k_lvl UNION ALL SELECT call_id, {2 * POINTS + 2}, round(d, 6) FROM k_lvl""",
    **CL,
)
def _(t):
    return _long(K.contour_features(_calls(t), "frequency_main"))


@query(
    "K3_features_modulation_main",
    f"""SELECT call_id, pos, round(m, 6) + 0e0 AS x FROM k_mod UNION ALL SELECT call_id, pos + {POINTS}, round(6e-1 * c, 6) + 0e0 FROM k_curv
   UNION ALL SELECT call_id, {2 * POINTS}, round(2e-1 * mf, 6) FROM k_lvl UNION ALL SELECT call_id, {2 * POINTS + 1}, round(5e-1 * sf, 6) FROM k_lvl UNION ALL SELECT call_id, {2 * POINTS + 2}, round(d, 6) FROM k_lvl""",
    **CL,
)
def _(t):
    return _long(K.contour_features(_calls(t), "modulation_main"))


@query("K4_standardise", "SELECT call_id, pos, round(x, 6) + 0e0 AS x FROM k_std", **CL)
def _(t):
    return _long(K.standardise(K.contour_features(_calls(t))))


@query("K5_embed2d")
def _(t):
    f = K.standardise(K.contour_features(_calls(t)))
    return rounded(K.embed2d(f).select("call_id", "x", "y"))


@query(
    "K6_knn",
    """SELECT call_id, CAST(rk AS INT) AS rank, neighbour, round(distance, 6) AS distance FROM
   (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY distance, neighbour) AS rk FROM
     (SELECT a.call_id, b.call_id AS neighbour, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS distance FROM k_std a JOIN k_std b ON b.pos = a.pos AND b.call_id <> a.call_id GROUP BY 1, 2)) WHERE rk <= 5""",
    **CL,
)
def _(t):
    f = K.standardise(K.contour_features(_calls(t)))
    return K.knn(f, 5).select("call_id", "rank", "neighbour", r6("distance").alias("distance"))


@query("K7_kmeans")
def _(t):
    f = K.standardise(K.contour_features(_calls(t)))
    return K.kmeans(K.embed2d(f), 4, 0).groupBy("cluster").agg(F.count(F.lit(1)).alias("calls"))


# a reproducible 2-D layout and labels: mean and deviation of F0, quartered by size
SIL = {
    "s_pt": "SELECT call_id, mf AS x, sf AS y, CAST(least(floor(n / 13e0), 3) AS INT) AS cluster FROM k_span",
    "s_size": "SELECT cluster AS other, count(*) AS k FROM s_pt GROUP BY 1",
}


def sil_ctes(d: str) -> dict[str, str]:
    return {
        "s_sum": f"SELECT a.call_id, a.cluster AS own, b.cluster AS other, sum({d}) AS total FROM s_pt a JOIN s_pt b ON true GROUP BY 1, 2, 3",
        "s_ab": """SELECT call_id, own AS cluster, max(total / (k - 1)) FILTER (WHERE own = other AND k > 1) AS a, min(total / k) FILTER (WHERE own <> other) AS b
          FROM s_sum JOIN s_size USING (other) GROUP BY 1, 2""",
        **SIL,
        **CL,
    }


_SIL = """SELECT call_id, cluster, round(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) <= 0 THEN 0e0 ELSE (b - a) / greatest(a, b) END, 6) + 0e0 AS silhouette FROM s_ab"""


def _layout(t):
    s = ST.contour_summary(t.contour).filter("n_points >= 2")
    label = F.least(F.floor(F.col("n_points") / 13.0), F.lit(3)).cast("int")
    return s.select("call_id", F.col("mean_frequency").alias("x"), F.col("std_frequency").alias("y"), label.alias("cluster"))


@query("K8_silhouette", _SIL, **sil_ctes("sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"))
def _(t):
    return rounded(K.silhouette(_layout(t)))


@query("K8_silhouette_squared", _SIL, **sil_ctes("(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"))
def _(t):
    return rounded(K.silhouette_squared(_layout(t)))


@query(
    "A16_cluster_contours",
    "SELECT cluster, pos, round(avg(f), 6) AS mean, round(stddev_pop(f), 6) + 0e0 AS std, count(*) AS n FROM k_con JOIN s_pt USING (call_id) GROUP BY 1, 2",
    **SIL,
    **CL,
)
def _(t):
    return rounded(ST.cluster_contours(_calls(t), _layout(t)))


