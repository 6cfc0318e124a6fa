"""Registered queries of smoothing, lookups and joins (W and J rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A

from ..functions import series as R
from ..operators import frames as FR
from ..operators import lookup as L
from ..operators import smooth as SM
from ..sources.adapters import TF_AXIS
from .base import query, r6

N_CALL = "SELECT call_id, count(*) AS n FROM contour GROUP BY 1"
OFF5 = "SELECT range - 2 AS o FROM range(5)"


@query(
    "W1_median_filter",
    f"""SELECT c.call_id, c.frame_idx, round(CASE WHEN any_value(c.frequency) > 0 THEN quantile_cont(d.frequency, 5e-1)
   ELSE any_value(c.frequency) END, 6) + 0e0 AS smoothed
  FROM contour c JOIN ({N_CALL}) USING (call_id) CROSS JOIN ({OFF5}) JOIN contour d ON d.call_id = c.call_id AND d.frame_idx =
   CASE WHEN ((c.frame_idx + o) % (2 * n) + 2 * n) % (2 * n) < n THEN ((c.frame_idx + o) % (2 * n) + 2 * n) % (2 * n)
        ELSE 2 * n - 1 - ((c.frame_idx + o) % (2 * n) + 2 * n) % (2 * n) END
  GROUP BY 1, 2""",
)
def _(t):
    return SM.median_filter(t.contour, 5).select("call_id", "frame_idx", r6("smoothed").alias("smoothed"))


@query(
    "W2_gated_median",
    f"""SELECT c.call_id, c.frame_idx, round(coalesce(m.med, c.frequency), 6) + 0e0 AS smoothed FROM contour c
  LEFT JOIN (SELECT g.call_id, any_value(g.frame_idx) AS frame_idx, g.rn, quantile_cont(h.frequency, 5e-1) AS med
    FROM gated g CROSS JOIN ({OFF5}) JOIN gated h ON h.call_id = g.call_id AND h.rn =
     CASE WHEN ((g.rn + o) % (2 * g.n) + 2 * g.n) % (2 * g.n) < g.n THEN ((g.rn + o) % (2 * g.n) + 2 * g.n) % (2 * g.n)
          ELSE 2 * g.n - 1 - ((g.rn + o) % (2 * g.n) + 2 * g.n) % (2 * g.n) END
    WHERE g.n > 5 GROUP BY g.call_id, g.rn) m USING (call_id, frame_idx)""",
    gated="""SELECT call_id, frame_idx, frequency, row_number() OVER (PARTITION BY call_id ORDER BY frame_idx) - 1 AS rn,
      count(*) OVER (PARTITION BY call_id) AS n FROM contour JOIN
      (SELECT call_id, quantile_cont(confidence, 25e-2) AS thr FROM contour WHERE confidence > 0 GROUP BY 1) USING (call_id)
      WHERE confidence > thr""",
)
def _(t):
    return SM.gated_median(t.contour, 5).select("call_id", "frame_idx", r6("smoothed").alias("smoothed"))


@query(
    "W3_voiced_run_median",
    """SELECT c.call_id, c.frame_idx, round(CASE WHEN any_value(c.frequency) > 0 THEN quantile_cont(d.frequency, 5e-1) ELSE 0e0 END, 6) + 0e0 AS smoothed
  FROM runs c CROSS JOIN (SELECT range - 1 AS o FROM range(3)) JOIN runs d ON d.call_id = c.call_id AND
    d.frame_idx = greatest(least(c.frame_idx + o, c.hi), c.lo) GROUP BY 1, 2""",
    runs="""SELECT call_id, frame_idx, frequency, min(frame_idx) OVER (PARTITION BY call_id, run, voiced) AS lo,
      max(frame_idx) OVER (PARTITION BY call_id, run, voiced) AS hi FROM
      (SELECT *, frequency > 0 AS voiced, sum(CASE WHEN frequency > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY call_id ORDER BY frame_idx) AS run FROM contour)""",
)
def _(t):
    return SM.voiced_run_median(t.contour, 3).select("call_id", "frame_idx", r6("smoothed").alias("smoothed"))


@query(
    "W4_modulation",
    """SELECT call_id, frame_idx, round(modulation, 6) + 0e0 AS modulation,
   round(modulation - coalesce(lag(modulation) OVER (PARTITION BY call_id ORDER BY frame_idx), modulation), 6) + 0e0 AS curvature FROM
  (SELECT call_id, frame_idx, frequency - coalesce(lag(frequency) OVER (PARTITION BY call_id ORDER BY frame_idx), frequency) AS modulation FROM contour)""",
)
def _(t):
    return SM.modulation(t.contour).select(
        "call_id", "frame_idx", r6("modulation").alias("modulation"), r6("curvature").alias("curvature")
    )


@query(
    "W5_channel_smoothing",
    """SELECT a.call_id, a.frame_idx, a.channel, round(sum(b.magnitude * exp(-5e-1 * (o / 2e0) * (o / 2e0))) /
    (SELECT sum(exp(-5e-1 * (range - 8) / 2e0 * (range - 8) / 2e0)) FROM range(17)), 6) + 0e0 AS gauss,
   round(sum(b.magnitude) FILTER (WHERE abs(o) <= 1) / 3e0, 6) + 0e0 AS box
  FROM tf a CROSS JOIN (SELECT range - 8 AS o FROM range(17)) JOIN tf b ON b.call_id = a.call_id AND b.frame_idx = a.frame_idx
   AND b.channel = greatest(least(a.channel + o, 49), 0) GROUP BY 1, 2, 3""",
)
def _(t):
    g = SM.gauss_smooth(t.tf_frame, 2.0).select("call_id", "frame_idx", F.col("mags").alias("g"))
    both = SM.box_smooth(t.tf_frame, 1).join(g, ["call_id", "frame_idx"])
    z = F.posexplode(F.arrays_zip("g", "mags")).alias("channel", "z")
    return both.select("call_id", "frame_idx", z).select(
        "call_id", "frame_idx", "channel", r6("z.g").alias("gauss"), r6("z.mags").alias("box")
    )


@query(
    "W6_energy_gate",
    """SELECT call_id, frame_idx, CASE WHEN confidence < 6e-1 * top THEN 0e0 ELSE frequency END AS frequency,
   CASE WHEN confidence < 6e-1 * top THEN 0e0 ELSE confidence END AS confidence
  FROM (SELECT *, max(confidence) OVER (PARTITION BY call_id) AS top FROM contour)""",
)
def _(t):
    c = t.contour.withColumn("peak", F.col("confidence"))
    return SM.energy_gate(c, 0.6).select("call_id", "frame_idx", "frequency", "confidence")


@query(
    "W7_cum_energy",
    """SELECT call_id, channel, round(sum(e) OVER (PARTITION BY call_id ORDER BY channel) / sum(e) OVER (PARTITION BY call_id), 6) AS cum
  FROM (SELECT call_id, channel, avg(magnitude * magnitude) AS e FROM tf GROUP BY 1, 2)""",
)
def _(t):
    psd = t.tf.groupBy("call_id", "channel").agg(
        F.min("freq_hz").alias("freq_hz"), F.avg(F.col("magnitude") * F.col("magnitude")).alias("psd")
    )
    return SM.cum_energy(psd).select("call_id", "channel", r6("cum").alias("cum"))


@query(
    "W9_frames",
    """SELECT w.call_id, CAST(m AS INT) AS frame_idx, CAST(k AS INT) AS k, coalesce(s.x, 0e0) AS zero, q.x AS reflected
  FROM (SELECT DISTINCT call_id FROM sample) w CROSS JOIN (SELECT range AS m FROM range(26)) CROSS JOIN (SELECT range AS k FROM range(256))
  JOIN (SELECT call_id, max(n) + 1 AS total FROM sample GROUP BY 1) z ON z.call_id = w.call_id AND m <= floor(z.total / 128e0)
  LEFT JOIN sample s ON s.call_id = w.call_id AND s.n = m * 128 + k - 128
  LEFT JOIN sample q ON q.call_id = w.call_id AND q.n = CASE WHEN abs(m * 128 + k - 128) < total THEN abs(m * 128 + k - 128)
      ELSE 2 * (total - 1) - (m * 128 + k - 128) END""",
)
def _(t):
    zero = FR.frames(t.waveform, 256, 128, True, "zero").withColumnRenamed("frame", "zero")
    refl = FR.frames(t.waveform, 256, 128, True, "reflect").withColumnRenamed("frame", "reflected")
    z = F.posexplode(F.arrays_zip("zero", "reflected")).alias("k", "z")
    return zero.join(refl, ["call_id", "frame_idx"]).select("call_id", "frame_idx", z).select(
        "call_id", "frame_idx", "k", F.col("z.zero").alias("zero"), F.col("z.reflected").alias("reflected")
    )


@query(
    "W10_edge_radius",
    f"""SELECT call_id, frame_idx, CASE WHEN frame_idx < 6 OR frame_idx >= n - 6 THEN 1 ELSE 3 END AS radius FROM contour JOIN ({N_CALL}) USING (call_id)""",
)
def _(t):
    return SM.edge_radius(t.contour, 192, 16, 3).select("call_id", "frame_idx", "radius")


@query(
    "W11_marker_bounds",
    """SELECT call_id, min(frame_idx) FILTER (WHERE start_point = 1) AS first_start, max(frame_idx) FILTER (WHERE start_point = 1) AS last_start,
   min(frame_idx) FILTER (WHERE end_point = 1) AS first_end, max(frame_idx) FILTER (WHERE end_point = 1) AS last_end FROM contour_ref GROUP BY 1""",
)
def _(t):
    return SM.marker_bounds(t.contour_ref)


@query(
    "W12_roughness",
    """SELECT call_id, round(coalesce(quantile_cont(d, 5e-1), 0e0), 6) AS roughness FROM
  (SELECT call_id, abs(frequency - lag(frequency) OVER (PARTITION BY call_id ORDER BY frame_idx)) AS d FROM contour) GROUP BY 1""",
)
def _(t):
    return SM.roughness(t.contour).select("call_id", r6("roughness").alias("roughness"))


@query(
    "J1_join_calls",
    """SELECT call_id, count(*) AS points, bool_or(matched) AS matched FROM
  (SELECT c.call_id, t.call_id IS NOT NULL AS matched FROM contour c LEFT JOIN (SELECT DISTINCT call_id FROM tf) t USING (call_id)) GROUP BY 1""",
)
def _(t):
    matched, missing = L.join_calls(t.contour.groupBy("call_id").agg(F.count(F.lit(1)).alias("points")), t.tf_call)
    left = t.contour.join(missing, "call_id", "left_semi").groupBy("call_id").agg(F.count(F.lit(1)).alias("points"))
    return matched.select("call_id", "points", F.lit(True).alias("matched")).unionByName(
        left.withColumn("matched", F.lit(False))
    )


@query(
    "J2_nearest",
    """SELECT call_id, frame_idx, arg_min(channel, (abs(1.7e1 + 1.3e0 * channel - frequency), channel)) AS idx
  FROM contour CROSS JOIN (SELECT CAST(range AS INT) AS channel FROM range(50)) GROUP BY 1, 2""",
)
def _(t):
    return L.nearest(t.contour, TF_AXIS, "frequency").select("call_id", "frame_idx", "idx")


@query(
    "J2_nearest_by_call",
    """SELECT call_id, frame_idx, round(arg_min(v, (abs(v - time), v)), 6) AS nearest FROM
  (SELECT c.call_id, c.frame_idx, c.time, t.time AS v FROM contour c LEFT JOIN (SELECT DISTINCT call_id, time FROM tf) t USING (call_id)) GROUP BY 1, 2""",
)
def _(t):
    out = L.nearest_by_call(t.contour, t.tf_frame, "time", "time")
    return out.select("call_id", "frame_idx", r6("nearest").alias("nearest"))


_AXES = """SELECT c.call_id, c.frame_idx, c.time, c.frequency, min(t.time) AS t0, max(t.time) AS t1,
    arg_min(t.frame_idx, (abs(t.time - c.time), t.frame_idx)) AS f FROM contour c
    LEFT JOIN (SELECT DISTINCT call_id, frame_idx, time FROM tf) t USING (call_id) GROUP BY ALL"""
_CH = "SELECT CAST(range AS INT) AS channel, 1.7e1 + 1.3e0 * range AS hz FROM range(50)"


@query(
    "J3_amplitude_at",
    f"""SELECT p.call_id, p.frame_idx, p.ok AS in_grid, coalesce(t.magnitude, -1e0) AS amplitude, coalesce(t.frame_idx, -1) AS amplitude_frame,
   coalesce(t.channel, -1) AS amplitude_channel, round(coalesce(t.time, -1e0), 6) AS amplitude_time, round(coalesce(t.freq_hz, -1e0), 6) AS amplitude_frequency
  FROM (SELECT q.*, arg_min(channel, (abs(hz - frequency), channel)) AS ch FROM
    (SELECT *, coalesce(frequency > 0 AND time >= t0 AND time <= t1 AND frequency >= 1.7e1 AND frequency <= 1.7e1 + 1.3e0 * 49, false) AS ok FROM located) q
    CROSS JOIN ({_CH}) GROUP BY ALL) p
  LEFT JOIN tf t ON p.ok AND t.call_id = p.call_id AND t.frame_idx = p.f AND t.channel = p.ch""",
    located=_AXES,
)
def _(t):
    out = L.amplitude_at(t.contour, t.tf_frame, TF_AXIS, fill=-1.0, include_indices=True)
    return out.select(
        "call_id",
        "frame_idx",
        "in_grid",
        "amplitude",
        "amplitude_frame",
        "amplitude_channel",
        r6("amplitude_time").alias("amplitude_time"),
        r6("amplitude_frequency").alias("amplitude_frequency"),
    )


@query(
    "J4_magnitude_at",
    f"""SELECT p.call_id, p.frame_idx, coalesce(t.magnitude, 0e0) AS magnitude
  FROM (SELECT q.*, arg_min(channel, (abs(hz - frequency), channel)) AS ch FROM
    (SELECT *, coalesce(frequency > 0 AND time >= t0 AND time <= t1, false) AS ok FROM located) q
    CROSS JOIN ({_CH}) GROUP BY ALL) p
  LEFT JOIN tf t ON p.ok AND t.call_id = p.call_id AND t.frame_idx = p.f AND t.channel = p.ch""",
    located=_AXES,
)
def _(t):
    return L.magnitude_at(t.contour, t.tf_frame, TF_AXIS).select("call_id", "frame_idx", "magnitude")


@query(
    "A18_coverage_points",
    """SELECT c.call_id, count(*) FILTER (WHERE frequency > 0 AND time >= t0 AND time <= t1 AND frequency >= 1.7e1 AND frequency <= 1.7e1 + 1.3e0 * 49) AS valid_points,
   count(*) AS total_points FROM contour c LEFT JOIN (SELECT call_id, min(time) AS t0, max(time) AS t1 FROM tf GROUP BY 1) USING (call_id) GROUP BY 1""",
)
def _(t):
    return L.coverage_points(L.amplitude_at(t.contour, t.tf_frame, TF_AXIS))


_TARGETS = [10.0 + 4.7 * i for i in range(20)]


@query(
    "J5_sample_rows",
    """SELECT g.call_id, g.frame_idx, g.target, hz >= 1.7e1 AND hz <= 1.7e1 + 1.3e0 * 49 AS valid,
   CASE WHEN hz >= 1.7e1 AND hz <= 1.7e1 + 1.3e0 * 49 THEN round((1e0 - a) * l.magnitude + a * r.magnitude, 6) + 0e0 ELSE 0e0 END AS value
  FROM (SELECT f.call_id, f.frame_idx, p.*, (hz - 1.7e1) / 1.3e0 - (rgt - 1) AS a FROM (SELECT DISTINCT call_id, frame_idx FROM tf) f CROSS JOIN
    (SELECT CAST(range AS INT) AS target, 1e1 + 4.7e0 * range AS hz, CAST(greatest(least(ceil((1e1 + 4.7e0 * range - 1.7e1) / 1.3e0), 49), 1) AS INT) AS rgt FROM range(20)) p) g
  JOIN tf l ON l.call_id = g.call_id AND l.frame_idx = g.frame_idx AND l.channel = rgt - 1
  JOIN tf r ON r.call_id = g.call_id AND r.frame_idx = g.frame_idx AND r.channel = rgt""",
)
def _(t):
    return L.sample_rows(t.tf_frame, TF_AXIS, _TARGETS).select(
        "call_id", "frame_idx", "target", "valid", r6("value").alias("value")
    )


@query(
    "J5_sample_path",
    """SELECT p.call_id, p.frame_idx, round((1e0 - a) * l.magnitude + a * r.magnitude, 6) + 0e0 AS value FROM
  (SELECT *, (frequency - 1.7e1) / 1.3e0 - (rgt - 1) AS a FROM (SELECT *, CAST(greatest(least(ceil((frequency - 1.7e1) / 1.3e0), 49), 1) AS INT) AS rgt FROM contour)) p
  JOIN tf l ON l.call_id = p.call_id AND l.frame_idx = p.frame_idx AND l.channel = rgt - 1
  JOIN tf r ON r.call_id = p.call_id AND r.frame_idx = p.frame_idx AND r.channel = rgt""",
)
def _(t):
    j = t.contour.join(t.tf_frame.select("call_id", "frame_idx", "mags"), ["call_id", "frame_idx"])
    return j.select(
        "call_id", "frame_idx", r6(L.sample_at(F.col("mags"), A.dlit(TF_AXIS), F.col("frequency"))).alias("value")
    )


@query(
    "J6_band_mean",
    """SELECT p.call_id, p.frame_idx, p.bin, round(avg(magnitude), 6) + 0e0 AS band_mean FROM
  (SELECT call_id, frame_idx, CAST(greatest(least(floor((frequency - 1.7e1) / 1.3e0), 49), 0) AS INT) AS bin FROM contour) p
  JOIN tf t ON t.call_id = p.call_id AND t.frame_idx = p.frame_idx AND t.channel BETWEEN p.bin - 2 AND p.bin + 2 GROUP BY 1, 2, 3""",
)
def _(t):
    b = F.greatest(F.least(F.floor((F.col("frequency") - 17.0) / 1.3).cast("int"), F.lit(49)), F.lit(0))
    pts = t.contour.select("call_id", "frame_idx", b.alias("bin"))
    return L.band_mean(pts, t.tf_frame, 2).select("call_id", "frame_idx", "bin", r6("band_mean").alias("band_mean"))


@query(
    "J7_neighbours",
    """SELECT call_id, frame_idx, base, CAST(base + o AS INT) AS bin FROM
  (SELECT call_id, frame_idx, CAST(greatest(least(floor((frequency - 1.7e1) / 1.3e0), 49), 0) AS INT) AS base FROM contour)
  CROSS JOIN (SELECT range - 3 AS o FROM range(7)) WHERE base + o >= 1 AND base + o <= 48""",
)
def _(t):
    b = F.greatest(F.least(F.floor((F.col("frequency") - 17.0) / 1.3).cast("int"), F.lit(49)), F.lit(0))
    return L.neighbours(t.contour.select("call_id", "frame_idx", b.alias("base")), 3, 50)


@query(
    "J8_apply_matrix",
    """SELECT call_id, frame_idx, CAST(k AS INT) AS channel, round(sum(magnitude * cos(pi() / 50 * (channel + 5e-1) * k) * sqrt(4e-2) *
   CASE WHEN k = 0 THEN sqrt(5e-1) ELSE 1e0 END), 6) + 0e0 AS magnitude
  FROM tf CROSS JOIN (SELECT range AS k FROM range(8)) GROUP BY 1, 2, 3""",
)
def _(t):
    m = L.matrix_table(t.spark, FR.dct_matrix(8, 50))
    return L.apply_matrix(t.tf, m).select("call_id", "frame_idx", "channel", r6("magnitude").alias("magnitude"))


@query(
    "J9_regrid",
    """SELECT call_id, m AS frame_idx, round(CASE WHEN x > t1 THEN 0e0 ELSE f0 + (f1 - f0) * (x - a * 1.6e-2) / 1.6e-2 END, 6) + 0e0 AS frequency FROM
  (SELECT g.call_id, g.m, g.x, g.t1, l.frame_idx AS a, l.frequency AS f0, coalesce(r.frequency, l.frequency) AS f1 FROM
    (SELECT call_id, CAST(range AS INT) AS m, range * 1e-2 AS x, t1, n, CAST(least(floor(range * 1e-2 / 1.6e-2 + 1e-9), n - 1) AS INT) AS a
     FROM (SELECT call_id, max(time) AS t1, count(*) AS n FROM contour GROUP BY 1) CROSS JOIN range(60)) g
    JOIN contour l ON l.call_id = g.call_id AND l.frame_idx = g.a LEFT JOIN contour r ON r.call_id = g.call_id AND r.frame_idx = g.a + 1)""",
)
def _(t):
    grid = (
        t.contour.select("call_id")
        .distinct()
        .select("call_id", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("frame_idx"))
        .withColumn("time", F.col("frame_idx") * 1e-2)
    )
    return L.regrid(t.contour, grid, 0.0, 0.0).select("call_id", "frame_idx", r6("frequency").alias("frequency"))


@query(
    "J9_half_pixel",
    f"""SELECT call_id, m AS frame_idx, round(l.frequency + (r.frequency - l.frequency) * (x - lo), 6) + 0e0 AS frequency FROM
  (SELECT call_id, m, x, CAST(least(floor(x), n - 1) AS INT) AS lo, CAST(least(floor(x) + 1, n - 1) AS INT) AS hi FROM
    (SELECT call_id, n, CAST(range AS INT) AS m, greatest((range + 5e-1) * n / 40e0 - 5e-1, 0e0) AS x FROM ({N_CALL}) CROSS JOIN range(40))) g
  JOIN (SELECT call_id AS c1, frame_idx AS i1, frequency FROM contour) l ON l.c1 = g.call_id AND l.i1 = g.lo
  JOIN (SELECT call_id AS c2, frame_idx AS i2, frequency FROM contour) r ON r.c2 = g.call_id AND r.i2 = g.hi""",
)
def _(t):
    packed = R.pack(t.contour, ["frequency"])
    return packed.select(
        "call_id", F.posexplode(L.resize(F.col("frequency"), F.lit(40))).alias("frame_idx", "f")
    ).select("call_id", "frame_idx", r6("f").alias("frequency"))


@query(
    "J10_with_params",
    """SELECT call_id, config_id, count(*) FILTER (WHERE frequency > floor_hz AND confidence > min_conf) AS kept FROM contour
  CROSS JOIN (VALUES (0, 2e1, 1e-1), (1, 3e1, 3e-1), (2, 4e1, 5e-1)) g(config_id, floor_hz, min_conf) GROUP BY 1, 2""",
)
def _(t):
    grid = [dict(floor_hz=20.0, min_conf=0.1), dict(floor_hz=30.0, min_conf=0.3), dict(floor_hz=40.0, min_conf=0.5)]
    rows = L.with_params(t.contour, grid)
    return rows.groupBy("call_id", "config_id").agg(
        F.count_if((F.col("frequency") > F.col("floor_hz")) & (F.col("confidence") > F.col("min_conf"))).alias("kept")
    )


@query(
    "J11_effective_contour",
    """SELECT call_id, frame_idx, round(time, 6) AS time, round(frequency, 6) + 0e0 AS frequency, source FROM (
   SELECT g.call_id, g.frame_idx, g.time, CASE WHEN f.call_id IS NULL THEN g.frequency WHEN g.time > f.t1 THEN 0e0 ELSE coalesce(c.frequency, 0e0) END AS frequency,
     CASE WHEN f.call_id IS NULL THEN g.source ELSE 'corrected' END AS source
   FROM (SELECT call_id, frame_idx, time, frequency, 'extracted' AS source FROM ext
     UNION ALL SELECT call_id, frame_idx, time, frequency, 'corrected' FROM cor WHERE call_id NOT IN (SELECT call_id FROM ext)
     UNION ALL SELECT call_id, CAST(range AS INT), range * 1.6e-2, 0e0, 'blank' FROM
       (SELECT -1 - call_id AS call_id, count(*) AS n FROM sample GROUP BY 1), range(100000) WHERE call_id NOT IN (SELECT call_id FROM ext) AND call_id NOT IN (SELECT call_id FROM cor)
        AND range < ceil(n / 1e3 / 1.6e-2 - 1e-9)) g
   LEFT JOIN (SELECT call_id, max(time) AS t1 FROM cor GROUP BY 1) f ON f.call_id = g.call_id
   LEFT JOIN cor c ON c.call_id = g.call_id AND c.frame_idx = g.frame_idx)""",
    ext="SELECT * FROM contour WHERE call_id IN (SELECT call_id FROM contour GROUP BY 1 HAVING count(*) >= 47)",
    cor="SELECT * FROM contour_ref WHERE call_id IN (SELECT call_id FROM contour_ref WHERE frame_idx = 40 AND end_point = 1)",
)
def _(t):
    """Long calls count as extracted, calls marked at frame 40 as corrected, waveforms have no contour."""
    long_calls = t.contour.groupBy("call_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 47")
    marked = SM.marker_bounds(t.contour_ref).filter("last_end = 40")
    ext = t.contour.join(long_calls, "call_id", "left_semi")
    cor = t.contour_ref.join(marked, "call_id", "left_semi")
    wf = t.waveform.withColumn("call_id", -1 - F.col("call_id"))
    out = L.effective_contour(ext, cor, wf, 1.6e-2)
    return out.select(
        "call_id", "frame_idx", r6("time").alias("time"), r6("frequency").alias("frequency"), "source"
    )


@query(
    "J11_effective_contour_all",
    """SELECT call_id, frame_idx, round(time, 6) AS time, round(frequency, 6) + 0e0 AS frequency, source FROM (
   SELECT g.call_id, g.frame_idx, g.time, CASE WHEN f.call_id IS NULL THEN g.frequency WHEN g.time > f.t1 THEN 0e0 ELSE coalesce(c.frequency, 0e0) END AS frequency,
     CASE WHEN f.call_id IS NULL THEN g.source ELSE 'corrected' END AS source
   FROM (SELECT call_id, frame_idx, time, frequency, 'extracted' AS source FROM ext
     UNION ALL SELECT call_id, frame_idx, time, frequency, 'corrected' FROM cor WHERE call_id NOT IN (SELECT call_id FROM ext)
     UNION ALL SELECT call_id, CAST(range AS INT), range * 1.6e-2, 0e0, 'blank' FROM
       (SELECT -1 - call_id AS call_id, count(*) AS n FROM sample GROUP BY 1), range(100000) WHERE call_id NOT IN (SELECT call_id FROM ext) AND call_id NOT IN (SELECT call_id FROM cor)
        AND range < ceil(n / 1e3 / 1.6e-2 - 1e-9)) g
   LEFT JOIN (SELECT call_id, max(time) AS t1 FROM cor GROUP BY 1) f ON f.call_id = g.call_id
   LEFT JOIN cor c ON c.call_id = g.call_id AND c.frame_idx = g.frame_idx)""",
    ext="SELECT * FROM contour WHERE call_id % 3 <> 1",
    cor="SELECT * FROM contour_ref WHERE call_id % 3 <> 0",
)
def _(t):
    """Every call is in a group: by id, a third is extracted only, a third corrected only, a third both; waveforms have none."""
    wf = t.waveform.withColumn("call_id", -1 - F.col("call_id"))
    out = L.effective_contour(t.contour.filter("call_id % 3 <> 1"), t.contour_ref.filter("call_id % 3 <> 0"), wf, 1.6e-2)
    return out.select(
        "call_id", "frame_idx", r6("time").alias("time"), r6("frequency").alias("frequency"), "source"
    )
