"""Registered queries of statistics, evaluation and ranking (A, W8, T, U rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import frames as FR
from ..operators import stats as ST
from ..sources import stores as SO
from ..sources.adapters import SAMPLE_RATE
from .base import query, r6


def rounded(df, *keep):
    """Round every double column for comparison."""
    return df.select(*[r6(c).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


@query(
    "A1_anchor",
    """SELECT call_id, p.peak_channel, s.start_frame FROM
  (SELECT call_id, arg_max(channel, (v, -channel)) AS peak_channel FROM (SELECT call_id, channel, avg(magnitude) AS v FROM tf GROUP BY 1, 2) GROUP BY 1) p
  JOIN (SELECT call_id, arg_max(frame_idx, (v, -frame_idx)) AS start_frame FROM (SELECT call_id, frame_idx, sum(magnitude) AS v FROM tf GROUP BY 1, 2) GROUP BY 1) s USING (call_id)""",
)
def _(t):
    return ST.anchor(t.tf)


@query(
    "A2_peak_share",
    """SELECT call_id, frame_idx, max(magnitude) AS peak, CASE WHEN sum(magnitude) > 0 THEN round(max(magnitude) / sum(magnitude), 6) ELSE 0e0 END AS share
  FROM tf WHERE freq_hz >= 22.5e0 AND freq_hz <= 5e1 GROUP BY 1, 2""",
)
def _(t):
    return rounded(ST.peak_share(X.band(t.tf, 22.5, 50.0)), "peak")


@query(
    "A5_duration_stats",
    """SELECT count(duration) AS n, min(duration) AS min, max(duration) AS max, round(avg(duration), 6) AS mean, round(stddev_pop(duration), 6) AS std,
   round(quantile_cont(duration, 1e-1), 6) AS p10, round(quantile_cont(duration, 25e-2), 6) AS p25, round(quantile_cont(duration, 5e-1), 6) AS p50,
   round(quantile_cont(duration, 75e-2), 6) AS p75, round(quantile_cont(duration, 9e-1), 6) AS p90, round(quantile_cont(duration, 95e-2), 6) AS p95,
   round(quantile_cont(duration, 99e-2), 6) AS p99, round(quantile_cont(duration, 5e-1), 6) AS median FROM duration""",
)
def _(t):
    return rounded(ST.duration_stats(t.duration))


@query(
    "A6_window_coverage",
    """SELECT size, usable, round(pct, 6) AS percent, coalesce(size = coalesce(max(size) FILTER (WHERE pct >= 9e1) OVER (), max(size) FILTER (WHERE pct >= 8e1) OVER ()), false) AS recommended
  FROM (SELECT size, count(*) FILTER (WHERE duration >= size) AS usable, 1e2 * count(*) FILTER (WHERE duration >= size) / count(*) AS pct
   FROM duration CROSS JOIN (SELECT unnest([1e0, 1.5e0, 2e0, 2.5e0, 3e0, 3.5e0, 4e0, 5e0, 6e0]) AS size) GROUP BY 1)""",
)
def _(t):
    return rounded(ST.window_coverage(t.duration))


@query(
    "A7_length_flags",
    """SELECT count(*) AS total, count(*) FILTER (WHERE duration < 2) AS short_calls, count(*) FILTER (WHERE duration > 10) AS long_calls,
   count(*) FILTER (WHERE duration < 4) AS excluded_calls, round(count(*) FILTER (WHERE duration < 2) / count(*), 6) AS short_share,
   round(count(*) FILTER (WHERE duration > 10) / count(*), 6) AS long_share, round(count(*) FILTER (WHERE duration < 4) / count(*), 6) AS excluded_share FROM duration""",
)
def _(t):
    return rounded(ST.length_flags(t.duration))


# Welch segments of 128 samples, half overlap: mean removed, periodic Hann, one-sided density at sr = 1000.
WELCH = {
    "w_seg": """SELECT s.call_id, m, s.n - m * 64 AS k, s.x FROM sample s JOIN (SELECT call_id, count(*) AS total FROM sample GROUP BY 1) z USING (call_id)
       CROSS JOIN (SELECT range AS m FROM range(60)) WHERE m * 64 + 128 <= total AND s.n >= m * 64 AND s.n < m * 64 + 128""",
    "w_win": """SELECT call_id, m, k, (x - avg(x) OVER (PARTITION BY call_id, m)) * (5e-1 - 5e-1 * cos(2e0 * pi() * k / 128e0)) AS y FROM w_seg""",
    "w_dft": """SELECT call_id, m, b, pow(sum(y * cos(2e0 * pi() * k * b / 128e0)), 2) + pow(sum(y * sin(2e0 * pi() * k * b / 128e0)), 2) AS p
       FROM w_win CROSS JOIN (SELECT range AS b FROM range(65)) GROUP BY 1, 2, 3""",
    "w_psd": """SELECT call_id, CAST(b AS INT) AS bin, avg(p) * CASE WHEN b IN (0, 64) THEN 1 ELSE 2 END /
       (1e3 * (SELECT sum(pow(5e-1 - 5e-1 * cos(2e0 * pi() * range / 128e0), 2)) FROM range(128))) AS psd FROM w_dft GROUP BY call_id, b""",
    "w_mean": "SELECT bin, bin * 1e3 / 128 AS freq_hz, avg(psd) AS psd FROM w_psd GROUP BY 1",
}


@query("A8_welch_psd", "SELECT call_id, bin, round(psd * 1e3, 6) + 0e0 AS psd FROM w_psd", **WELCH)
def _(t):
    psd = ST.welch_psd(t.waveform, SAMPLE_RATE, 128)
    return psd.select("call_id", F.posexplode("psd").alias("bin", "p")).select(
        "call_id", "bin", r6(F.col("p") * 1e3).alias("psd")
    )


@query("A8_mean_psd", "SELECT bin, freq_hz, round(psd * 1e3, 6) + 0e0 AS psd FROM w_mean", **WELCH)
def _(t):
    return ST.mean_psd(t.waveform, SAMPLE_RATE, 128).select("bin", "freq_hz", r6(F.col("psd") * 1e3).alias("psd"))


@query(
    "A9_spectral_summary",
    """SELECT arg_max(freq_hz, (psd, -freq_hz)) AS peak_hz, min(freq_hz) FILTER (WHERE cum >= 9e-1) AS f90_hz,
   min(freq_hz) FILTER (WHERE cum >= 9e-1) < 25e1 AS low_energy, arg_max(freq_hz, (psd, -freq_hz)) < 5e1 AS low_peak
  FROM (SELECT *, sum(psd) OVER (ORDER BY freq_hz) / sum(psd) OVER () AS cum FROM w_mean)""",
    **WELCH,
)
def _(t):
    return ST.spectral_summary(ST.mean_psd(t.waveform, SAMPLE_RATE, 128), SAMPLE_RATE)


@query(
    "W8_duration_ecdf",
    """SELECT duration, count(*) AS n, round(sum(count(*)) OVER (ORDER BY duration) / (SELECT count(*) FROM duration), 6) AS ecdf FROM duration GROUP BY 1""",
)
def _(t):
    return ST.duration_ecdf(t.duration).select("duration", "n", r6("ecdf").alias("ecdf"))


@query(
    "A10_mean_delta",
    "SELECT call_id, round(avg(abs(b.frequency - a.frequency)), 6) AS mean_delta FROM contour a JOIN contour_ref b USING (call_id, frame_idx) GROUP BY 1",
)
def _(t):
    return rounded(ST.mean_delta(t.contour, t.contour_ref))


@query(
    "A10_overall_delta",
    """SELECT round(avg(d), 6) AS mean_delta, count(*) AS calls FROM
  (SELECT avg(abs(b.frequency - a.frequency)) AS d FROM contour a JOIN contour_ref b USING (call_id, frame_idx) GROUP BY call_id)""",
)
def _(t):
    return rounded(ST.overall_delta(ST.mean_delta(t.contour, t.contour_ref)))


@query(
    "A11_contour_summary",
    """SELECT call_id, count(*) AS n_points, round(max(time) - min(time), 6) AS duration_sec, round(avg(frequency / 2e0), 6) AS mean_frequency,
   round(stddev_pop(frequency / 2e0), 6) AS std_frequency FROM contour WHERE frequency > 0 GROUP BY 1""",
)
def _(t):
    return rounded(ST.contour_summary(t.contour))


@query("A13_dedupe_times", "SELECT call_id, round(time, 6) AS time, round(avg(freq), 6) AS freq FROM both_points GROUP BY call_id, both_points.time",
    both_points="SELECT * FROM correction UNION ALL SELECT call_id, frame_idx * 1.6e-2 AS time, frequency AS freq FROM contour WHERE frequency > 0")
def _(t):
    from ..operators import edit as E

    pts = t.correction.unionByName(
        t.contour.filter("frequency > 0").select("call_id", "time", F.col("frequency").alias("freq"))
    )
    return rounded(E.dedupe_times(pts))


EVAL = {
    "e_pair": """SELECT call_id, frame_idx, a.frequency / 2e0 AS p, b.frequency / 2e0 AS r FROM contour a JOIN contour_ref b USING (call_id, frame_idx)
      WHERE a.frequency > 0 AND b.frequency > 0""",
    "e_step": """SELECT *, CASE WHEN lag(frame_idx) OVER w = frame_idx - 1 THEN p - lag(p) OVER w END AS dp,
      CASE WHEN lag(frame_idx) OVER w = frame_idx - 1 THEN r - lag(r) OVER w END AS dr FROM e_pair WINDOW w AS (PARTITION BY call_id ORDER BY frame_idx)""",
    "e_call": """SELECT call_id, count(*) AS frames, avg(abs(p - r)) AS mae_hz, quantile_cont(abs(log2(p / r)) * 12e2, 5e-1) AS median_cents,
      avg(CAST(abs(log2(p / r)) * 12e2 <= 25 AS INT)) AS within_25, avg(CAST(abs(log2(p / r)) * 12e2 > 200 AS INT)) AS gross_200,
      avg(abs(dp - dr)) AS step_mae_hz, CASE WHEN count(dp) >= 2 AND stddev_pop(dp) > 0 AND stddev_pop(dr) > 0 THEN corr(dp, dr) END AS fm_corr FROM e_step GROUP BY 1""",
}
_METRICS = ["mae_hz", "median_cents", "within_25", "gross_200", "step_mae_hz", "fm_corr"]


@query("A14_evaluate", "SELECT call_id, frames, " + ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS) + " FROM e_call", **EVAL)
def _(t):
    return rounded(ST.evaluate(t.contour, t.contour_ref))


@query("A14_macro_average", "SELECT count(*) AS calls, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in _METRICS) + " FROM e_call", **EVAL)
def _(t):
    return rounded(ST.macro_average(ST.evaluate(t.contour, t.contour_ref)))


def _eval_sql(pred: str) -> dict[str, str]:
    return {
        "g_pair": f"""SELECT call_id, frame_idx, a.frequency / 2e0 AS p, b.frequency / 2e0 AS r FROM {pred} a JOIN contour_ref b USING (call_id, frame_idx)
      WHERE a.frequency > 0 AND b.frequency > 0""",
        "g_step": EVAL["e_step"].replace("e_pair", "g_pair"),
        "g_call": EVAL["e_call"].replace("e_step", "g_step"),
    }


@query(
    "A15_win_counts",
    """SELECT count(*) FILTER (WHERE a.fm_corr > b.fm_corr) AS better_fm, count(*) FILTER (WHERE a.step_mae_hz < b.step_mae_hz) AS lower_step,
  count(*) FILTER (WHERE a.mae_hz < b.mae_hz) AS lower_mae, count(*) AS calls FROM e_call a JOIN g_call b USING (call_id)""",
    shifted="SELECT call_id, frame_idx, CASE WHEN frequency > 0 THEN frequency * (1e0 + 1e-3 * (frame_idx % 30)) ELSE 0e0 END AS frequency FROM contour",
    **EVAL,
    **_eval_sql("shifted"),
)
def _(t):
    drift = t.contour.withColumn(
        "frequency",
        F.when(F.col("frequency") > 0, F.col("frequency") * (1.0 + 1e-3 * (F.col("frame_idx") % 30))).otherwise(0.0),
    )
    return ST.win_counts(ST.evaluate(t.contour, t.contour_ref), ST.evaluate(drift, t.contour_ref))


@query(
    "T1_first_n",
    "SELECT call_id, duration FROM duration ORDER BY call_id LIMIT 25 OFFSET 10",
)
def _(t):
    return SO.first_n(t.duration, 25, 10)


@query(
    "T2_sorted_axis",
    """SELECT call_id, frame_idx, CAST(row_number() OVER (PARTITION BY call_id, frame_idx ORDER BY hz, channel) - 1 AS INT) AS channel, round(hz, 6) AS freq_hz, magnitude
  FROM (SELECT *, 1e2 - freq_hz AS hz FROM tf)""",
)
def _(t):
    flipped = t.tf.withColumn("freq_hz", 100.0 - F.col("freq_hz"))
    return SO.sorted_axis(flipped).select("call_id", "frame_idx", "channel", r6("freq_hz").alias("freq_hz"), "magnitude")


@query("T3_sample_calls", "SELECT * FROM duration ORDER BY md5('7:' || CAST(call_id AS VARCHAR)), call_id LIMIT 50")
def _(t):
    return SO.sample_calls(t.duration, 50, 7)


@query(
    "U1_union_sources",
    """SELECT call_id, min(duration) AS duration FROM (SELECT * FROM duration UNION ALL SELECT doc_id, n_chars / 1e3 + 1e0 FROM documents JOIN labels USING (doc_id)
   UNION ALL SELECT doc_id + 1000000, n_chars / 1e3 FROM documents JOIN labels USING (doc_id)) GROUP BY 1""",
)
def _(t):
    labelled = t.duration.join(t.raw("labels").select(F.col("doc_id").alias("call_id")), "call_id", "left_semi")
    other = labelled.withColumn("duration", F.col("duration") + 1.0)
    extra = labelled.withColumn("call_id", F.col("call_id") + 1_000_000)
    return SO.union_sources(t.duration, other, extra)


@query(
    "U2_set_difference",
    "SELECT doc_id AS call_id, n_chars / 1e3 AS duration FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def _(t):
    done = t.raw("labels").select(F.col("doc_id").alias("call_id"))
    return SO.missing_calls(t.duration, done)


@query(
    "S3_samples",
    "SELECT call_id, n, x FROM sample",
)
def _(t):
    return FR.to_samples(t.waveform)


@query(
    "S4_mono",
    """SELECT CAST(floor(vec_id / 5e1) AS BIGINT) AS call_id, CAST(i AS INT) AS n, round(avg(CAST(embedding[i + 1] AS DOUBLE)), 6) + 0e0 AS x
   FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings) GROUP BY 1, 2""",
)
def _(t):
    ch = t.raw("embeddings").groupBy(F.floor(F.col("vec_id") / 50).cast("bigint").alias("call_id")).agg(
        F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("p")
    )
    stereo = ch.select("call_id", F.transform("p", lambda s: s["embedding"].cast("array<double>")).alias("samples"))
    return FR.to_samples(FR.to_mono(stereo)).select("call_id", "n", r6("x").alias("x"))


@query(
    "S5_pad_min",
    """SELECT call_id, count(*) AS n, round(sum(x), 6) + 0e0 AS total FROM (SELECT call_id, x FROM sample UNION ALL
   SELECT call_id, 0e0 FROM (SELECT call_id, count(*) AS n FROM sample GROUP BY 1), range(4000) WHERE range >= n) GROUP BY 1""",
)
def _(t):
    s = FR.to_samples(FR.pad_min(t.waveform, 4000))
    return s.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("x")).alias("total"))


