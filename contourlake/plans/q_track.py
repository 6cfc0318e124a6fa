"""Registered queries of trackers, lattices and refinement (A3, A4, A12, T4, T5, P rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import frames as FR
from ..operators import hybrid as H
from ..operators import refine as RF
from ..operators import smooth as SM
from ..operators import stats as ST
from ..operators import track as TR
from ..sources.adapters import TF_AXIS
from .base import query, r6
from .q_scalar import aud_sql, hz_sql
from .q_stats import rounded

RIDGE = TR.RidgeConfig(max_jump=4.0)
HYB = H.HybridConfig(
    h1_min=17.0,
    h1_max=80.0,
    candidate_step=1.0,
    proposal_jump=4.0,
    radius=3.0,
    n_harmonics=5,
    contrast_sigma=2.0,
    transition_scale=1.0,
    max_jump=4.0,
)


def calls_of(t):
    return FR.pack_calls(t.tf_frame)


# ---------------------------------------------------------------- ridge tracker

def mirror_median(src: str, idx: str = "frame_idx") -> str:
    m = f"((c.{idx} + o) % (2 * c.n) + 2 * c.n) % (2 * c.n)"
    return f"""SELECT c.call_id, c.{idx}, quantile_cont(d.v, 5e-1) AS med FROM {src} c CROSS JOIN (SELECT range - 2 AS o FROM range(5))
     JOIN {src} d ON d.call_id = c.call_id AND d.{idx} = CASE WHEN {m} < c.n THEN {m} ELSE 2 * c.n - 1 - {m} END GROUP BY 1, 2"""


TRACK_POST = {
    "rm": mirror_median("rp"),
    "rg": """SELECT call_id, frame_idx, time, peak, CASE WHEN peak < 2e-1 * top THEN 0e0 ELSE med END AS f, CASE WHEN peak < 2e-1 * top THEN 0e0 ELSE share END AS c
      FROM (SELECT rp.*, rm.med, max(peak) OVER (PARTITION BY rp.call_id) AS top FROM rp JOIN rm USING (call_id, frame_idx))""",
    "rs": """SELECT call_id, frame_idx, f AS v, row_number() OVER (PARTITION BY call_id ORDER BY frame_idx) - 1 AS rn, count(*) OVER (PARTITION BY call_id) AS n
      FROM rg JOIN (SELECT call_id, quantile_cont(c, 25e-2) AS thr FROM rg WHERE c > 0 GROUP BY 1) USING (call_id) WHERE c > thr""",
    "rq": mirror_median("rs", "rn"),
    "ridge_rows": """SELECT g.call_id, g.frame_idx, g.time, CASE WHEN s.n > 5 THEN q.med ELSE g.f END AS frequency, g.c AS confidence, g.peak
      FROM rg g LEFT JOIN rs s USING (call_id, frame_idx) LEFT JOIN rq q ON q.call_id = s.call_id AND q.rn = s.rn""",
}


def track_ctes(src: str, axis: str, lo: str, hi: str, jump: str) -> dict[str, str]:
    """Ridge tracker over a grid table and its (channel, hz) axis."""
    near = f"abs(b.freq_hz - x.hz) <= {jump}"

    def step(name: str, d: str) -> str:
        return f"""SELECT b.call_id, b.frame_idx, arg_max(b.channel, (b.magnitude, -b.channel)) AS channel FROM {name} p
     JOIN ax x ON x.channel = p.channel JOIN bt b ON b.call_id = p.call_id AND b.frame_idx = p.frame_idx {d} 1 AND {near} GROUP BY 1, 2"""
    return {
        "ax": axis,
        "bt": f"SELECT call_id, frame_idx, channel, freq_hz, magnitude, time FROM {src} WHERE freq_hz >= {lo} AND freq_hz <= {hi}",
        "p2a": "SELECT call_id, frame_idx, arg_max(channel, (magnitude, -channel)) AS channel FROM bt WHERE frame_idx = 0 GROUP BY 1, 2 UNION ALL "
        + step("p2a", "+"),
        "anc": """SELECT call_id, p.c AS channel, s.f AS start FROM
   (SELECT call_id, arg_max(channel, (v, -channel)) AS c FROM (SELECT call_id, channel, avg(magnitude) AS v FROM bt GROUP BY 1, 2) GROUP BY 1) p
   JOIN (SELECT call_id, arg_max(frame_idx, (v, -frame_idx)) AS f FROM (SELECT call_id, frame_idx, sum(magnitude) AS v FROM bt GROUP BY 1, 2) GROUP BY 1) s USING (call_id)""",
        "st": f"""SELECT b.call_id, b.frame_idx, arg_max(b.channel, (b.magnitude, -b.channel)) AS channel FROM anc a JOIN ax x ON x.channel = a.channel
     JOIN bt b ON b.call_id = a.call_id AND b.frame_idx = a.start AND {near} GROUP BY 1, 2""",
        "fwd": "SELECT * FROM st UNION ALL " + step("fwd", "+"),
        "bwd": "SELECT * FROM st UNION ALL " + step("bwd", "-"),
        "p2b": "SELECT * FROM fwd UNION SELECT * FROM bwd",
        "rp": """SELECT p.call_id, p.frame_idx, b.time, b.freq_hz AS v, b.magnitude AS peak, CASE WHEN z.total > 0 THEN b.magnitude / z.total ELSE 0e0 END AS share,
     count(*) OVER (PARTITION BY p.call_id) AS n FROM p2b p JOIN bt b USING (call_id, frame_idx, channel)
     JOIN (SELECT call_id, frame_idx, sum(magnitude) AS total FROM bt GROUP BY 1, 2) z USING (call_id, frame_idx)""",
        **TRACK_POST,
    }


TF_AXIS_SQL = "SELECT CAST(range AS INT) AS channel, 1.7e1 + 1.3e0 * range AS hz FROM range(50)"
TRACK = track_ctes("tf", TF_AXIS_SQL, "22.5e0", "5e1", "4e0")


@query("P1_allowed_peak", """SELECT b.call_id, b.frame_idx, arg_max(b.channel, (b.magnitude, -b.channel)) AS channel FROM bt b JOIN anc a USING (call_id) JOIN ax x ON x.channel = a.channel
   WHERE abs(b.freq_hz - x.hz) <= 4e0 GROUP BY 1, 2""", **TRACK)
def _(t):
    cut, f = TR.band_frames(F.col("frames"), TF_AXIS, 22.5, 50.0)
    first = TF_AXIS.index(f[0])
    lo, hi = (A.ilit(v) for v in TR._reach(f, 4.0))
    calls = calls_of(t).select("call_id", cut.alias("v")).withColumn("a", TR.anchor(F.col("v"))["channel"])
    rows = calls.select("call_id", "a", F.posexplode("v").alias("frame_idx", "fr"))
    return rows.select(
        "call_id", "frame_idx", (TR.allowed_peak(F.col("fr"), F.col("a"), lo, hi) + first).cast("int").alias("channel")
    )


@query("P2a_track_causal", "SELECT call_id, frame_idx, channel FROM p2a", **TRACK)
def _(t):
    cut, f = TR.band_frames(F.col("frames"), TF_AXIS, 22.5, 50.0)
    path = TR.track_causal(cut, f, 4.0)
    first = TF_AXIS.index(f[0])
    return calls_of(t).select("call_id", F.posexplode(path).alias("frame_idx", "c")).select(
        "call_id", "frame_idx", (F.col("c") + first).cast("int").alias("channel")
    )


@query("P2b_track_outward", "SELECT call_id, frame_idx, channel FROM p2b", **TRACK)
def _(t):
    cut, f = TR.band_frames(F.col("frames"), TF_AXIS, 22.5, 50.0)
    path = TR.track_outward(cut, f, 4.0)
    first = TF_AXIS.index(f[0])
    return calls_of(t).select("call_id", F.posexplode(path).alias("frame_idx", "c")).select(
        "call_id", "frame_idx", (F.col("c") + first).cast("int").alias("channel")
    )


_RIDGE_SQL = """SELECT call_id, frame_idx, round(time, 6) AS time, round(frequency, 6) + 0e0 AS frequency, round(confidence, 6) + 0e0 AS confidence, peak FROM ridge_rows"""


@query("P3_track_ridge", _RIDGE_SQL, **TRACK)
def _(t):
    return rounded(TR.track_ridge(calls_of(t), TF_AXIS, RIDGE), "peak")


@query(
    "P3_ridge_summary",
    """SELECT call_id, count(*) AS n_points, round(max(time) - min(time), 6) AS duration_sec, round(avg(frequency / 2e0), 6) AS mean_frequency,
   round(stddev_pop(frequency / 2e0), 6) AS std_frequency FROM ridge_rows WHERE frequency > 0 GROUP BY 1""",
    **TRACK,
)
def _(t):
    return rounded(ST.contour_summary(TR.track_ridge(calls_of(t), TF_AXIS, RIDGE)))


@query("P4_track_store", _RIDGE_SQL, **TRACK)
def _(t):
    return rounded(TR.track_store(t.tf, TF_AXIS, RIDGE), "peak")


# ---------------------------------------------------------------- lattices

GAUSS = "(SELECT sum(exp(-5e-1 * (range - 8) / 2e0 * (range - 8) / 2e0)) FROM range(17))"


def robust(src: str, col: str, state: str = "s") -> str:
    """(call_id, frame_idx, state, z) of a lattice column."""
    return f"""SELECT call_id, frame_idx, {state}, least(greatest(({col} - m) / greatest(1.4826e0 * d, fl), -8e0), 12e0) AS z FROM {src}
      JOIN (SELECT *, greatest(1e-1 * quantile_cont(d, 5e-1) OVER (PARTITION BY call_id), 1e-5) AS fl FROM
       (SELECT call_id, frame_idx, any_value(m) AS m, quantile_cont(abs({col} - m), 5e-1) AS d FROM {src}
         JOIN (SELECT call_id, frame_idx, quantile_cont({col}, 5e-1) AS m FROM {src} GROUP BY 1, 2) USING (call_id, frame_idx) GROUP BY 1, 2)) USING (call_id, frame_idx)"""


def lattice_ctes(src: str = "tf", top: str = "49", a0: str = "1.7e1", da: str = "1.3e0", radius: int = 1) -> dict[str, str]:
    """Lattices of ``HYB`` over a grid with axis ``a0 + da * c``."""
    return {
        "h_eps": f"SELECT call_id, quantile_cont(magnitude, 5e-1) * 1e-6 AS eps FROM {src} WHERE magnitude > 0 GROUP BY 1",
        "h_log": f"SELECT call_id, frame_idx, channel, ln(greatest(magnitude, eps)) AS x FROM {src} JOIN h_eps USING (call_id)",
        "h_raw": f"""SELECT a.call_id, a.frame_idx, a.channel, any_value(a.x) - sum(b.x * exp(-5e-1 * (o / 2e0) * (o / 2e0))) / {GAUSS} AS x
          FROM h_log a CROSS JOIN (SELECT range - 8 AS o FROM range(17)) JOIN h_log b ON b.call_id = a.call_id AND b.frame_idx = a.frame_idx
           AND b.channel = greatest(least(a.channel + o, {top}), 0) GROUP BY 1, 2, 3""",
        "h_scale": """SELECT *, greatest(1e-1 * quantile_cont(q, 5e-1) OVER (PARTITION BY call_id), 1e-6) AS fl FROM
          (SELECT call_id, frame_idx, quantile_cont(abs(x), 75e-2) AS q FROM h_raw GROUP BY 1, 2)""",
        "h_con": """SELECT call_id, frame_idx, channel, least(greatest(x / greatest(q, fl), -4e0), 6e0) AS x FROM h_raw JOIN h_scale USING (call_id, frame_idx)""",
        "h_tgt": f"""SELECT *, hz >= {a0} AND hz <= {a0} + {da} * {top} AS valid, CAST(greatest(least(ceil((hz - {a0}) / {da}), {top}), 1) AS INT) - 1 AS lo,
           (hz - {a0}) / {da} - (greatest(least(ceil((hz - {a0}) / {da}), {top}), 1) - 1) AS a FROM
           (SELECT 'r' AS kind, CAST(range AS INT) AS s, 1e0 AS w, 1.7e1 + range AS hz FROM range(64)
            UNION ALL SELECT 'h', CAST(s.range AS INT), pow(k.range, -35e-2), k.range * 5e-1 * (1.7e1 + s.range) FROM range(64) s, range(2, 6) k
            UNION ALL SELECT 'i', CAST(s.range AS INT), pow(k.range, -35e-2), (k.range + 5e-1) * 5e-1 * (1.7e1 + s.range) FROM range(64) s, range(2, 6) k)""",
        "h_wsum": "SELECT kind, s, greatest(sum(CASE WHEN valid THEN w ELSE 0e0 END), 1e-12) AS ws FROM h_tgt GROUP BY 1, 2",
        "h_evid": """SELECT l.call_id, l.frame_idx, t.s, sum(t.w * ((1e0 - a) * l.x + a * r.x)) FILTER (WHERE t.kind = 'r' AND valid) AS ridge,
           coalesce(sum(t.w * ((1e0 - a) * l.x + a * r.x) / ws) FILTER (WHERE t.kind = 'h' AND valid), 0e0)
            - 3e-1 * coalesce(sum(t.w * ((1e0 - a) * l.x + a * r.x) / ws) FILTER (WHERE t.kind = 'i' AND valid), 0e0) AS shrp
          FROM h_tgt t JOIN h_wsum USING (kind, s) JOIN h_con l ON l.channel = t.lo JOIN h_con r ON r.call_id = l.call_id AND r.frame_idx = l.frame_idx AND r.channel = t.lo + 1
          GROUP BY 1, 2, 3""",
        "h_anchor": """SELECT l.call_id, l.frame_idx, t.s, (1e0 - a) * l.x + a * r.x AS anchor FROM h_tgt t JOIN h_log l ON l.channel = t.lo
          JOIN h_log r ON r.call_id = l.call_id AND r.frame_idx = l.frame_idx AND r.channel = t.lo + 1 WHERE t.kind = 'r'""",
        "h_box": f"""SELECT a.call_id, a.frame_idx, a.channel, sum(b.magnitude * b.magnitude) / {2 * radius + 1}e0 AS x FROM {src} a CROSS JOIN (SELECT range - {radius} AS o FROM range({2 * radius + 1}))
          JOIN {src} b ON b.call_id = a.call_id AND b.frame_idx = a.frame_idx AND b.channel = greatest(least(a.channel + o, {top}), 0) GROUP BY 1, 2, 3""",
        "h_pow0": """SELECT l.call_id, l.frame_idx, t.s, coalesce(sum(t.w * ((1e0 - a) * l.x + a * r.x) / ws) FILTER (WHERE valid), 0e0) AS x
          FROM h_tgt t JOIN h_wsum USING (kind, s) JOIN h_box l ON l.channel = t.lo JOIN h_box r ON r.call_id = l.call_id AND r.frame_idx = l.frame_idx AND r.channel = t.lo + 1
          WHERE t.kind = 'h' GROUP BY 1, 2, 3""",
        "h_power": """SELECT call_id, frame_idx, s, ln(greatest(x, eps)) AS power FROM h_pow0
          JOIN (SELECT call_id, quantile_cont(x, 5e-1) * 1e-8 AS eps FROM h_pow0 WHERE x > 0 GROUP BY 1) USING (call_id)""",
        "z_ridge": robust("h_evid", "ridge"),
        "z_shrp": robust("h_evid", "shrp"),
        "z_anchor": robust("h_anchor", "anchor"),
        "z_power": robust("h_power", "power"),
        "h_hybrid": "SELECT call_id, frame_idx, s, 65e-2 * a.z + b.z AS x FROM z_ridge a JOIN z_shrp b USING (call_id, frame_idx, s)",
        "z_hybrid": robust("h_hybrid", "x"),
        "h_hpower": "SELECT call_id, frame_idx, s, 65e-2 * a.z + b.z AS x FROM z_ridge a JOIN z_power b USING (call_id, frame_idx, s)",
        "z_hybrid_power": robust("h_hpower", "x"),
    }


LAT = lattice_ctes()


@query("A3_robust_z", "SELECT call_id, frame_idx, channel, round(z, 6) + 0e0 AS z FROM z_tf", z_tf=robust("tf", "magnitude", "channel"))
def _(t):
    z = F.posexplode(H.robust_z(F.col("frames"))).alias("frame_idx", "fr")
    return calls_of(t).select("call_id", z).select("call_id", "frame_idx", F.posexplode("fr").alias("channel", "z")).select(
        "call_id", "frame_idx", "channel", r6("z").alias("z")
    )


@query("A4_contrast", "SELECT call_id, frame_idx, channel, round(x, 6) + 0e0 AS contrast FROM h_con", **LAT)
def _(t):
    z = F.posexplode(H.contrast(F.col("frames"), 50, 2.0)).alias("frame_idx", "fr")
    return calls_of(t).select("call_id", z).select("call_id", "frame_idx", F.posexplode("fr").alias("channel", "z")).select(
        "call_id", "frame_idx", "channel", r6("z").alias("contrast")
    )


def lattice_rows(calls, *cols):
    z = F.arrays_zip(*[F.flatten(c).alias(c) for c in cols])
    n = len(HYB.candidates())
    rows = calls.select("call_id", F.posexplode(z).alias("i", "z"))
    return rows.select(
        "call_id",
        F.floor(F.col("i") / n).cast("int").alias("frame_idx"),
        (F.col("i") % n).alias("s"),
        *[r6(F.col(f"z.{c}"), 5).alias(c) for c in cols],
    )


@query(
    "P6_shrp_lattice",
    """SELECT call_id, frame_idx, s, round(ridge, 5) + 0e0 AS ridge, round(shrp, 5) + 0e0 AS shrp, round(anchor, 5) + 0e0 AS anchor, round(x, 5) + 0e0 AS combined
   FROM h_evid JOIN h_anchor USING (call_id, frame_idx, s) JOIN h_hybrid USING (call_id, frame_idx, s)""",
    **LAT,
)
def _(t):
    c = H.with_lattices(calls_of(t), TF_AXIS, HYB).withColumn("combined", H.emission("hybrid", HYB))
    return lattice_rows(c, "ridge", "shrp", "anchor", "combined")


@query("P7_power_lattice", "SELECT call_id, frame_idx, s, round(power, 5) + 0e0 AS power FROM h_power", **LAT)
def _(t):
    c = calls_of(t).withColumn("power", H.power_lattice(F.col("frames"), H.lattice_maps(TF_AXIS, HYB)))
    return lattice_rows(c, "power")


BAND = {
    "b_prof": "SELECT call_id, s, quantile_cont(anchor, 75e-2) AS p FROM h_anchor GROUP BY 1, 2",
    "b_ev": "SELECT call_id, s, quantile_cont(z, 75e-2) AS e FROM z_shrp GROUP BY 1, 2",
    "b_top": "SELECT call_id, arg_max(s, (p, -s)) AS top, quantile_cont(p, 5e-1) AS m FROM b_prof GROUP BY 1",
    "b_mad": "SELECT call_id, greatest(1.4826e0 * quantile_cont(abs(p - m), 5e-1), 1e-6) AS sp FROM b_prof JOIN b_top USING (call_id) GROUP BY 1",
    "b_hyp": """SELECT DISTINCT call_id, arg_min(s, (abs(1.7e1 + s - hz), s)) AS s FROM
       (SELECT call_id, r, r * (1.7e1 + top) AS hz FROM b_top CROSS JOIN (SELECT unnest([5e-1, 1e0, 2e0]) AS r))
       CROSS JOIN (SELECT CAST(range AS INT) AS s FROM range(64)) WHERE hz >= 1.7e1 AND hz <= 8e1 GROUP BY call_id, r""",
    "b_pick": """SELECT call_id, 1.7e1 + arg_max(s, (e + 35e-2 * (p - m) / sp, -s)) AS c FROM b_hyp JOIN b_prof USING (call_id, s) JOIN b_ev USING (call_id, s)
       JOIN b_top USING (call_id) JOIN b_mad USING (call_id) GROUP BY 1""",
}


@query(
    "P8_select_band",
    """SELECT call_id, min(1.7e1 + range) AS low, max(1.7e1 + range) AS high FROM b_pick, range(64)
   WHERE 1.7e1 + range >= greatest(1.7e1, c - 1.2e1) AND 1.7e1 + range <= least(8e1, c + 1.2e1) GROUP BY 1""",
    **LAT,
    **BAND,
)
def _(t):
    c = H.with_lattices(calls_of(t), TF_AXIS, HYB)
    return c.withColumn("b", H.select_band(F.col("anchor"), F.col("shrp"), HYB, 24.0)).select("call_id", "b.low", "b.high")


def proposal_ctes(src: str = "tf", a0: str = "1.7e1", da: str = "1.3e0") -> dict[str, str]:
    near = f"abs(b.freq_hz - ({a0} + {da} * p.channel)) <= 4e0"
    return {
        "q_band": "SELECT * FROM (VALUES (1, 17e0, 30e0), (2, 22.5e0, 40e0), (3, 30e0, 58e0), (4, 50e0, 80e0)) v(b, lo, hi)",
        "q_cell": f"SELECT q.b AS band, t.call_id, t.frame_idx, t.channel, t.freq_hz, t.magnitude FROM {src} t JOIN q_band q ON t.freq_hz >= q.lo AND t.freq_hz <= q.hi",
        "q_start": """SELECT band, call_id, p.c AS channel, s.f AS start FROM
           (SELECT band, call_id, arg_max(channel, (v, -channel)) AS c FROM (SELECT band, call_id, channel, avg(magnitude) AS v FROM q_cell GROUP BY 1, 2, 3) GROUP BY 1, 2) p
           JOIN (SELECT band, call_id, arg_max(frame_idx, (v, -frame_idx)) AS f FROM (SELECT band, call_id, frame_idx, sum(magnitude) AS v FROM q_cell GROUP BY 1, 2, 3) GROUP BY 1, 2) s
           USING (band, call_id)""",
        "q_first": f"""SELECT b.band, b.call_id, b.frame_idx, arg_max(b.channel, (b.magnitude, -b.channel)) AS channel FROM q_start p JOIN q_cell b
           ON b.band = p.band AND b.call_id = p.call_id AND b.frame_idx = p.start AND {near} GROUP BY 1, 2, 3""",
        "q_fwd": f"""SELECT * FROM q_first UNION ALL SELECT b.band, b.call_id, b.frame_idx, arg_max(b.channel, (b.magnitude, -b.channel)) FROM q_fwd p JOIN q_cell b
           ON b.band = p.band AND b.call_id = p.call_id AND b.frame_idx = p.frame_idx + 1 AND {near} GROUP BY 1, 2, 3""",
        "q_bwd": f"""SELECT * FROM q_first UNION ALL SELECT b.band, b.call_id, b.frame_idx, arg_max(b.channel, (b.magnitude, -b.channel)) FROM q_bwd p JOIN q_cell b
           ON b.band = p.band AND b.call_id = p.call_id AND b.frame_idx = p.frame_idx - 1 AND {near} GROUP BY 1, 2, 3""",
        "q_path": f"SELECT band, call_id, frame_idx, {a0} + {da} * channel AS hz FROM (SELECT * FROM q_fwd UNION SELECT * FROM q_bwd)",
        "q_samp": """SELECT p.band, p.call_id, quantile_cont((1e0 - a) * sl.z + a * sr.z, 5e-1) AS shrp_score, quantile_cont((1e0 - a) * al.z + a * ar.z, 5e-1) AS ridge_score FROM
           (SELECT *, hz - 1.7e1 - (rgt - 1) AS a FROM (SELECT *, CAST(greatest(least(ceil(hz - 1.7e1), 63), 1) AS INT) AS rgt FROM q_path)) p
           JOIN z_shrp sl ON sl.call_id = p.call_id AND sl.frame_idx = p.frame_idx AND sl.s = rgt - 1 JOIN z_shrp sr ON sr.call_id = p.call_id AND sr.frame_idx = p.frame_idx AND sr.s = rgt
           JOIN z_anchor al ON al.call_id = p.call_id AND al.frame_idx = p.frame_idx AND al.s = rgt - 1 JOIN z_anchor ar ON ar.call_id = p.call_id AND ar.frame_idx = p.frame_idx AND ar.s = rgt
           GROUP BY 1, 2""",
        "q_rough": """SELECT band, call_id, quantile_cont(hz, 5e-1) AS median_h1, coalesce(quantile_cont(d, 5e-1), 0e0) AS roughness FROM
           (SELECT *, abs(hz - lag(hz) OVER (PARTITION BY band, call_id ORDER BY frame_idx)) AS d FROM q_path) GROUP BY 1, 2""",
        "q_all": """SELECT band, call_id, median_h1, shrp_score, ridge_score, roughness, shrp_score + 35e-2 * ridge_score - 5e-2 * roughness AS score
           FROM q_samp JOIN q_rough USING (band, call_id)""",
        "q_near": """SELECT call_id, max(CASE WHEN x = 1 AND y = 2 THEN d END) AS d12, max(CASE WHEN x = 1 AND y = 3 THEN d END) AS d13, max(CASE WHEN x = 2 AND y = 3 THEN d END) AS d23,
            max(CASE WHEN x = 1 AND y = 4 THEN d END) AS d14, max(CASE WHEN x = 2 AND y = 4 THEN d END) AS d24, max(CASE WHEN x = 3 AND y = 4 THEN d END) AS d34 FROM
            (SELECT p.call_id, p.band AS x, q.band AS y, CAST(quantile_cont(abs(p.hz - q.hz), 5e-1) < 5e-1 AS INT) AS d FROM q_path p JOIN q_path q
              ON q.call_id = p.call_id AND q.frame_idx = p.frame_idx AND q.band > p.band GROUP BY 1, 2, 3) GROUP BY 1""",
        "q_keep": """SELECT call_id, 1 AS k1, k2, k3, CASE WHEN d14 = 1 OR (k2 = 1 AND d24 = 1) OR (k3 = 1 AND d34 = 1) THEN 0 ELSE 1 END AS k4 FROM
           (SELECT *, CASE WHEN d13 = 1 OR (k2 = 1 AND d23 = 1) THEN 0 ELSE 1 END AS k3 FROM (SELECT *, 1 - d12 AS k2 FROM q_near))""",
        "q_prop": """SELECT q_all.* FROM q_all JOIN q_keep USING (call_id) WHERE CASE band WHEN 1 THEN k1 WHEN 2 THEN k2 WHEN 3 THEN k3 ELSE k4 END = 1""",
        "q_broad": f"""SELECT call_id, {a0} + {da} * arg_max(channel, (v, -channel)) AS hz FROM
           (SELECT call_id, channel, avg(magnitude) AS v FROM {src} WHERE freq_hz >= 17e0 AND freq_hz <= 80e0 GROUP BY 1, 2) GROUP BY 1""",
        "q_pick": """SELECT call_id, CASE WHEN any_value(hz) >= 22.5e0 THEN arg_min(band, (abs(median_h1 - hz), band)) ELSE arg_max(band, (score, -band)) END AS band
           FROM q_prop JOIN q_broad USING (call_id) GROUP BY 1""",
        "q_coarse": "SELECT call_id, frame_idx, hz AS c FROM q_path JOIN q_pick USING (call_id, band)",
        "q_med": "SELECT call_id, quantile_cont(c, 5e-1) AS med, min(c) AS lo, max(c) AS hi FROM q_coarse GROUP BY 1",
        "q_sel": "SELECT call_id, arg_min(band, (abs(median_h1 - med), band)) AS band FROM q_prop JOIN q_med USING (call_id) GROUP BY 1",
        "q_conf": """SELECT call_id, 1e0 / (1e0 + exp(-least(greatest(coalesce(any_value(p.score) FILTER (WHERE p.band = s.band) - max(p.score) FILTER (WHERE p.band <> s.band), 12e0), -12e0), 12e0))) AS pc
           FROM q_prop p JOIN q_sel s USING (call_id) GROUP BY 1""",
    }


PROP = proposal_ctes()


@query(
    "P5_coarse_path",
    "SELECT call_id, frame_idx, round(hz, 6) AS hz FROM q_path WHERE band = 2",
    **PROP,
    **LAT,
)
def _(t):
    path = H.coarse_path(F.col("frames"), TF_AXIS, (22.5, 40.0), 4.0)
    return calls_of(t).select("call_id", F.posexplode(path).alias("frame_idx", "hz")).select(
        "call_id", "frame_idx", r6("hz").alias("hz")
    )


def proposals_of(t):
    return H.with_proposals(H.with_lattices(calls_of(t), TF_AXIS, HYB), TF_AXIS, HYB)


_PROP_COLS = ["median_h1", "shrp_score", "ridge_score", "roughness", "score"]


@query(
    "P9_proposals",
    "SELECT call_id, lo AS band_lo, hi AS band_hi, "
    + ", ".join(f"round({c}, 5) + 0e0 AS {c}" for c in _PROP_COLS)
    + " FROM q_prop JOIN q_band ON q_band.b = q_prop.band",
    **PROP,
    **LAT,
)
def _(t):
    p = proposals_of(t).select("call_id", F.explode("proposals").alias("p"))
    return p.select("call_id", "p.band_lo", "p.band_hi", *[r6(F.col(f"p.{c}"), 5).alias(c) for c in _PROP_COLS])


@query(
    "A12_proposal_score",
    "SELECT call_id, round(max(score), 5) AS best_score, round(min(score), 5) AS worst_score FROM q_prop GROUP BY 1",
    **PROP,
    **LAT,
)
def _(t):
    s = F.transform("proposals", lambda p: p["score"])
    return proposals_of(t).select(
        "call_id", r6(F.array_max(s), 5).alias("best_score"), r6(F.array_min(s), 5).alias("worst_score")
    )


@query(
    "T4_pick_proposal",
    "SELECT call_id, lo AS band_lo FROM q_pick JOIN q_band ON q_band.b = q_pick.band",
    **PROP,
    **LAT,
)
def _(t):
    c = proposals_of(t).withColumn("k", H.pick_proposal(F.col("frames"), TF_AXIS, HYB))
    return c.select("call_id", F.get("proposals", F.col("k"))["band_lo"].alias("band_lo"))


@query(
    "T5_dedupe_proposals",
    "SELECT call_id, CAST(k1 + k2 + k3 + k4 AS INT) AS kept FROM q_keep",
    **PROP,
    **LAT,
)
def _(t):
    return proposals_of(t).select("call_id", F.size("proposals").alias("kept"))


def viterbi_ctes(emission: str, cand: int = 64) -> dict[str, str]:
    """Best path over (call_id, frame_idx, s, x): step 1, jump 4, cost 0.04 * delta^2; ties to the highest predecessor."""
    return {
        "v_dp": f"""SELECT call_id, frame_idx, s, x AS dp, [s] AS path FROM {emission} WHERE frame_idx = 0
          UNION ALL SELECT e.call_id, e.frame_idx, e.s, any_value(e.x) + max(p.dp - 4e-2 * (e.s - p.s) * (e.s - p.s)),
            list_append(arg_max(p.path, (p.dp - 4e-2 * (e.s - p.s) * (e.s - p.s), p.s)), e.s)
          FROM v_dp p JOIN {emission} e ON e.call_id = p.call_id AND e.frame_idx = p.frame_idx + 1 AND abs(e.s - p.s) <= 4 GROUP BY 1, 2, 3""",
        "v_best": """SELECT call_id, arg_max(path, (dp, -s)) AS path FROM v_dp JOIN
          (SELECT call_id, max(frame_idx) AS frame_idx FROM v_dp GROUP BY 1) USING (call_id, frame_idx) GROUP BY 1""",
        "v_idx": "SELECT call_id, CAST(i AS INT) AS frame_idx, path[i + 1] AS s FROM (SELECT call_id, path, unnest(range(0, len(path))) AS i FROM v_best)",
        "v_path": f"""SELECT v.call_id, v.frame_idx, v.s, 1.7e1 + v.s + CASE WHEN v.s > 0 AND v.s < {cand - 1} AND abs(l.x - 2e0 * m.x + r.x) > 1e-12
            THEN least(greatest(5e-1 * (l.x - r.x) / (l.x - 2e0 * m.x + r.x), -75e-2), 75e-2) ELSE 0e0 END AS hz
          FROM v_idx v JOIN {emission} m ON m.call_id = v.call_id AND m.frame_idx = v.frame_idx AND m.s = v.s
          LEFT JOIN {emission} l ON l.call_id = v.call_id AND l.frame_idx = v.frame_idx AND l.s = v.s - 1
          LEFT JOIN {emission} r ON r.call_id = v.call_id AND r.frame_idx = v.frame_idx AND r.s = v.s + 1""",
    }


@query(
    "P10_gate",
    "SELECT call_id, frame_idx, count(*) FILTER (WHERE x > -1e5) AS open, round(sum(x) FILTER (WHERE x > -1e5), 5) + 0e0 AS total FROM g_power GROUP BY 1, 2",
    g_power="""SELECT z.call_id, z.frame_idx, z.s, CASE WHEN abs(1.7e1 + z.s - c) <= 3e0 THEN z ELSE -1e6 END AS x FROM z_power z JOIN q_coarse USING (call_id, frame_idx)""",
    **PROP,
    **LAT,
)
def _(t):
    c = proposals_of(t).withColumn("k", H.pick_proposal(F.col("frames"), TF_AXIS, HYB))
    c = c.withColumn("z", H.robust_z(F.col("power"))).withColumn("c", F.get("proposals", F.col("k"))["path"])
    g = H.gate(F.col("z"), A.dlit(HYB.candidates()), F.col("c"), HYB.radius)
    rows = c.select("call_id", F.posexplode(g).alias("frame_idx", "fr"))
    kept = F.filter("fr", lambda x: x > -1e5)
    return rows.select(
        "call_id",
        "frame_idx",
        F.size(kept).cast("bigint").alias("open"),
        r6(A.array_sum(kept), 5).alias("total"),
    )


_VIT = "SELECT call_id, frame_idx, s AS idx, round(hz, 5) + 0e0 AS hz FROM v_path"
_VIT_SRC = {"v_em": "SELECT call_id, frame_idx, s, round_even(z * 1e9, 0) / 1e9 AS x FROM z_hybrid", **viterbi_ctes("v_em"), **LAT}


def _viterbi(t, strategy):
    c = H.with_lattices(calls_of(t), TF_AXIS, HYB).withColumn("z", H.robust_z(H.emission("hybrid", HYB)))
    v = H.viterbi(F.col("z"), HYB.candidates(), 0.04, 1.0, 4.0, strategy)
    rows = c.withColumn("v", v).select("call_id", F.posexplode(F.arrays_zip("v.idx", "v.hz")).alias("frame_idx", "q"))
    return rows.select("call_id", "frame_idx", F.col("q.idx").cast("int").alias("idx"), r6(F.col("q.hz"), 5).alias("hz"))


@query("P11_viterbi", _VIT, **_VIT_SRC)
def _(t):
    return _viterbi(t, "expr")


@query("P11_viterbi_arrow", _VIT, **_VIT_SRC)
def _(t):
    return _viterbi(t, "arrow")


def conf_ctes(z: str) -> dict[str, str]:
    return {
        "c_near": f"""SELECT v.call_id, v.frame_idx, any_value(v.hz) AS hz, arg_min(z.z, (abs(1.7e1 + z.s - v.hz), z.s)) AS chosen,
            max(z.z) FILTER (WHERE abs(1.7e1 + z.s - v.hz) >= 75e-2) AS rival FROM v_path v JOIN {z} z ON z.call_id = v.call_id AND z.frame_idx = v.frame_idx GROUP BY 1, 2""",
        "c_conf": "SELECT call_id, frame_idx, hz, 1e0 / (1e0 + exp(-least(greatest(chosen - coalesce(rival, chosen), -12e0), 12e0))) AS conf FROM c_near",
    }


@query("P12_path_conf", "SELECT call_id, frame_idx, round(conf, 5) AS conf FROM c_conf", **_VIT_SRC, **conf_ctes("z_hybrid"))
def _(t):
    h1 = HYB.candidates()
    c = H.with_lattices(calls_of(t), TF_AXIS, HYB).withColumn("z", H.robust_z(H.emission("hybrid", HYB)))
    c = c.withColumn("v", H.viterbi(F.col("z"), h1, 0.04, 1.0, 4.0))
    conf = H.path_conf(F.col("z"), h1, F.col("v.hz"))
    return c.select("call_id", F.posexplode(conf).alias("frame_idx", "c")).select(
        "call_id", "frame_idx", r6("c", 5).alias("conf")
    )


def hybrid_ctes(component: str, grid: dict[str, str] | None = None) -> dict[str, str]:
    z = f"z_{component}"
    return {
        "v_em": f"SELECT z.call_id, z.frame_idx, z.s, CASE WHEN abs(1.7e1 + z.s - c) <= 3e0 THEN round_even(z * 1e9, 0) / 1e9 ELSE -1e6 END AS x FROM {z} z JOIN q_coarse USING (call_id, frame_idx)",
        **viterbi_ctes("v_em"),
        **conf_ctes(z),
        "hy_rows": "SELECT call_id, frame_idx, hz, conf * pc AS confidence FROM c_conf JOIN q_conf USING (call_id)",
        **(grid or {**PROP, **LAT}),
    }


_HY = """SELECT call_id, frame_idx, round(frame_idx * 5e-2, 6) AS time, round(hz, 5) AS frequency, round(hz / 2e0, 5) AS f0, round(confidence, 5) AS confidence FROM hy_rows"""


def _hybrid(t, component):
    rows = H.contour_rows(H.track_hybrid(calls_of(t), TF_AXIS, HYB, component))
    return rows.select(
        "call_id",
        "frame_idx",
        r6("time").alias("time"),
        *[r6(c, 5).alias(c) for c in ("frequency", "f0", "confidence")],
    )


for _component in H.COMPONENTS:

    @query(f"P13_track_{_component}", _HY, **hybrid_ctes(_component))
    def _(t, component=_component):
        return _hybrid(t, component)


@query(
    "P13_track_summary",
    """SELECT call_id, round(pc, 5) AS proposal_confidence, min(1.7e1 + range) AS band_lo, max(1.7e1 + range) AS band_hi
   FROM q_conf JOIN q_med USING (call_id), range(64) WHERE 1.7e1 + range >= greatest(17e0, lo - 3e0) AND 1.7e1 + range <= least(80e0, hi + 3e0) GROUP BY 1, 2""",
    **PROP,
    **LAT,
)
def _(t):
    s = H.track_summary(H.track_hybrid(calls_of(t), TF_AXIS, HYB))
    return s.select("call_id", r6("proposal_confidence", 5).alias("proposal_confidence"), "band_lo", "band_hi")


# ---------------------------------------------------------------- refinement

REF_AUD = RF.RefineConfig(
    sr=200.0, n_harmonics=6, neighbor_radius=3, bin_radius=1, min_f0=8.0, median_kernel=3, edge_kernel=40, stride=10
)
REF_LIN = RF.RefineConfig(sr=200.0, n_harmonics=6, neighbor_radius=2, bin_radius=1, min_f0=8.0, median_kernel=3, stride=10)


def refine_ctes(scale: str | None, grids: list[str], radius: int, edge: int, top: int) -> dict[str, str]:
    warp = (lambda x: x) if scale is None else (lambda x: aud_sql(scale, x))
    back = "v" if scale is None else hz_sql(scale, "v")
    axis = "SELECT CAST(range AS INT) AS channel, 1.7e1 + 1.3e0 * range AS hz FROM range(50)"
    score = " UNION ALL ".join(
        f"""SELECT c.call_id, c.frame_idx, c.bin, sl.w * avg(t.magnitude) / (any_value(nm.m) + 1e-12) AS part, sl.k AS k, {i} AS g FROM r_cand c JOIN r_slot sl USING (bin)
          JOIN {g} t ON t.call_id = c.call_id AND t.frame_idx = c.fr AND t.channel BETWEEN sl.h - 1 AND sl.h + 1
          JOIN (SELECT call_id, frame_idx, avg(magnitude) AS m FROM {g} GROUP BY 1, 2) nm ON nm.call_id = c.call_id AND nm.frame_idx = c.fr GROUP BY c.call_id, c.frame_idx, c.bin, sl.k, sl.w"""
        for i, g in enumerate(grids)
    )
    return {
        "r_axis": axis,
        "r_n": "SELECT call_id, max(frame_idx) AS last FROM tf GROUP BY 1",
        "r_in": """SELECT c.call_id, c.frame_idx, c.frequency, c.frequency / 2e0 AS f0, CAST(greatest(least(round_even(c.time * 2e2 / 10, 0), last), 0) AS INT) AS fr,
            count(*) OVER (PARTITION BY c.call_id) AS n FROM contour c JOIN r_n USING (call_id)""",
        "r_base": f"""SELECT i.call_id, i.frame_idx, any_value(fr) AS fr, CASE WHEN {edge} > 0 AND (i.frame_idx < {edge} OR i.frame_idx >= any_value(n) - {edge}) THEN 1 ELSE {radius} END AS r,
            arg_min(a.channel, (abs({warp("a.hz")} - {warp("f0")}), a.channel)) AS base FROM r_in i CROSS JOIN r_axis a WHERE f0 > 8e0 GROUP BY 1, 2""",
        "r_cand": f"""SELECT call_id, frame_idx, fr, CAST(base + o AS INT) AS bin FROM r_base CROSS JOIN (SELECT range - 5 AS o FROM range(11))
            WHERE abs(o) <= r AND base + o >= 1 AND base + o <= {top}""",
        "r_slot": f"""SELECT a.channel AS bin, CAST(k AS INT) AS k, any_value(pow(k, -35e-2)) AS w, arg_min(b.channel, (abs({warp("b.hz")} - {warp("(k * a.hz)")}), b.channel)) AS h
            FROM r_axis a CROSS JOIN (SELECT range AS k FROM range(1, 7)) CROSS JOIN r_axis b WHERE k <= floor(1e2 / a.hz) AND k * a.hz < 1e2 GROUP BY a.channel, k""",
        "r_part": score,
        "r_score": "SELECT call_id, frame_idx, bin, sum(part) AS sc FROM r_part GROUP BY 1, 2, 3",
        "r_best": "SELECT call_id, frame_idx, arg_max(bin, (sc, -bin)) AS bin, min(bin) AS lo, max(bin) AS hi FROM r_score GROUP BY 1, 2",
        "r_place": f"""SELECT b.call_id, b.frame_idx, CASE WHEN b.bin > lo AND b.bin < hi AND abs(l.sc - 2e0 * m.sc + r.sc) > 1e-12
            THEN least(greatest(b.bin + least(greatest(5e-1 * (l.sc - r.sc) / (l.sc - 2e0 * m.sc + r.sc), -1e0), 1e0), 1e0), {top}e0) ELSE b.bin END AS x
          FROM r_best b JOIN r_score m ON m.call_id = b.call_id AND m.frame_idx = b.frame_idx AND m.bin = b.bin
          LEFT JOIN r_score l ON l.call_id = b.call_id AND l.frame_idx = b.frame_idx AND l.bin = b.bin - 1
          LEFT JOIN r_score r ON r.call_id = b.call_id AND r.frame_idx = b.frame_idx AND r.bin = b.bin + 1""",
        "r_hz": f"""SELECT call_id, frame_idx, {back} AS f FROM (SELECT p.call_id, p.frame_idx, {warp("a.hz")} + ({warp("b.hz")} - {warp("a.hz")}) * (x - floor(x)) AS v
          FROM r_place p JOIN r_axis a ON a.channel = CAST(floor(x) AS INT) JOIN r_axis b ON b.channel = least(CAST(floor(x) AS INT) + 1, 49))""",
        "r_out": """SELECT i.call_id, i.frame_idx, i.frequency, CASE WHEN i.f0 > 8e0 THEN coalesce(h.f, i.f0) WHEN i.f0 <= 0 THEN 0e0 ELSE i.f0 END AS f
          FROM r_in i LEFT JOIN r_hz h USING (call_id, frame_idx)""",
        "r_run": """SELECT *, min(frame_idx) OVER (PARTITION BY call_id, run, f > 0) AS lo, max(frame_idx) OVER (PARTITION BY call_id, run, f > 0) AS hi FROM
          (SELECT *, sum(CASE WHEN f > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY call_id ORDER BY frame_idx) AS run FROM r_out)""",
        "r_done": """SELECT c.call_id, c.frame_idx, 2e0 * CASE WHEN any_value(c.f) > 0 THEN quantile_cont(d.f, 5e-1) ELSE 0e0 END AS frequency, any_value(c.frequency) AS frequency_original
          FROM r_run c CROSS JOIN (SELECT range - 1 AS o FROM range(3)) JOIN r_run d ON d.call_id = c.call_id AND d.frame_idx = greatest(least(c.frame_idx + o, c.hi), c.lo) GROUP BY 1, 2""",
    }


_REF = "SELECT call_id, frame_idx, round(frequency, 5) + 0e0 AS frequency, round(frequency_original, 6) + 0e0 AS frequency_original FROM r_done"


def _ref_rows(df):
    return df.select(
        "call_id", "frame_idx", r6("frequency", 5).alias("frequency"), r6("frequency_original").alias("frequency_original")
    )


@query("P16_refine_aud", _REF, **refine_ctes("elelog", ["tf"], 3, 2, 48))
def _(t):
    return _ref_rows(RF.refine_aud(t.contour, [(t.tf_frame, TF_AXIS)], REF_AUD))


@query(
    "P17_refine_stft",
    _REF,
    tf_box="""SELECT a.call_id, a.frame_idx, a.channel, sum(b.magnitude) / 3e0 AS magnitude FROM tf a CROSS JOIN (SELECT range - 1 AS o FROM range(3))
      JOIN tf b ON b.call_id = a.call_id AND b.frame_idx = a.frame_idx AND b.channel = greatest(least(a.channel + o, 49), 0) GROUP BY 1, 2, 3""",
    **refine_ctes(None, ["tf", "tf_box"], 2, 0, 49),
)
def _(t):
    return _ref_rows(RF.refine_stft(t.contour, [(t.tf_frame, TF_AXIS), (SM.box_smooth(t.tf_frame, 1), TF_AXIS)], REF_LIN))


