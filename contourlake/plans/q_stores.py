"""Registered queries of sources, sinks and jobs (S rows, P18, K9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames as FR
from ..session import scratch_table
from ..sources import stores as SO
from ..sources.adapters import TF_CHANNELS
from . import jobs as J
from .base import query, r6
from .q_stats import rounded
from .q_transform import FBC, SR, coeff_ctes, spectrum_ctes


def contour_folder(t):
    """The contour table written as CSV with an odd header, unparsable and negative cells."""
    path = scratch_table(t.spark, "contours")
    text = F.when(F.col("frequency") == 0, F.lit("n/a")).when(
        F.col("confidence") < 0.05, F.format_string("%.6f", -F.col("frequency"))
    ).otherwise(F.format_string("%.6f", "frequency"))
    t.contour.select("call_id", "frame_idx", F.format_string("%.6f", "time").alias("time"), text.alias("F0_Hz")).write.option(
        "header", True
    ).csv(path)
    return path


@query(
    "S1_read_contours",
    "SELECT call_id, frame_idx, round(time, 6) AS time, CASE WHEN confidence < 5e-2 THEN 0e0 ELSE frequency END AS frequency, 'peak' AS version FROM contour",
)
def _(t):
    df = SO.read_contours(t.spark, contour_folder(t), "peak")
    return df.select(
        F.col("call_id").cast("bigint").alias("call_id"),
        F.col("frame_idx").cast("int").alias("frame_idx"),
        "time",
        "frequency",
        "version",
    )


@query(
    "S2_require_columns",
    """SELECT 'contour' AS name, true AS usable, count(*) AS cells FROM contour UNION ALL SELECT 'markers', true, count(*) FROM contour_ref
   UNION ALL SELECT 'points', false, count(*) FROM correction""",
)
def _(t):
    out = None
    for name, df in (("contour", t.contour), ("markers", t.contour_ref), ("points", t.correction)):
        ok = SO.has_columns(df, ("time", "frequency"))
        row = df.agg(F.count(F.lit(1)).alias("cells")).select(F.lit(name).alias("name"), F.lit(ok).alias("usable"), "cells")
        out = row if out is None else out.unionByName(row)
    return out


@query("S6_read_tf", "SELECT call_id, frame_idx, channel, round(time, 6) AS time, round(freq_hz, 6) AS freq_hz, round(magnitude, 6) AS magnitude FROM tf")
def _(t):
    """A store that keeps some cells as magnitude, some as decibels, some as complex parts, without times."""
    path = scratch_table(t.spark, "tf")
    kind = F.col("channel") % 3
    m = F.col("magnitude")
    t.tf.select(
        "call_id",
        "frame_idx",
        "channel",
        "freq_hz",
        F.when((kind == 0) | (m <= 0), m).alias("magnitude"),
        F.when((kind == 1) & (m > 0), F.log10(F.when(m > 0, m)) * 20.0).alias("db"),
        F.when(kind == 2, m * 0.6).alias("re"),
        F.when(kind == 2, m * -0.8).alias("im"),
        F.lit("mixed").alias("representation"),
    ).write.partitionBy("representation").parquet(path)
    return rounded(SO.read_tf(t.spark, path, "mixed", 50, 1000))


@query(
    "S6_inconsistent_calls",
    "SELECT DISTINCT call_id FROM tf WHERE magnitude = 0 AND channel < 25",
)
def _(t):
    """Calls that fail the frames x channels check once the silent cells of the lower half are missing."""
    return SO.inconsistent_calls(t.tf.filter("magnitude > 0 OR channel >= 25"), TF_CHANNELS)


_S7 = spectrum_ctes("spec", 128, 64, 128, 1, 51)


@query(
    "S7_stft_store",
    """SELECT call_id, frame_idx, bin - 1 AS channel, round(bin * 1e3 / 128, 6) AS freq_hz, round(magnitude, 6) + 0e0 AS magnitude,
   round(greatest(2e1 * log10(greatest(magnitude, 1e-5)) - 2e1 * log10(greatest(max(magnitude) OVER (PARTITION BY call_id), 1e-5)), -8e1), 5) + 0e0 AS db FROM spec""",
    **_S7,
)
def _(t):
    path = scratch_table(t.spark, "stft")
    cfg = FR.MultiResConfig(sr=SR, hop=64, coarse_n_fft=128, coarse_win=128, fine_n_fft=128, fine_win=128, fmin=5.0, fmax=400.0)
    SO.write_stft_store(t.waveform, path, cfg)
    df = t.spark.read.parquet(path).filter("representation = 'stft'")
    return df.select(
        "call_id",
        "frame_idx",
        "channel",
        r6("freq_hz").alias("freq_hz"),
        r6("magnitude").alias("magnitude"),
        r6("db", 5).alias("db"),
    )


@query(
    "S8_fb_store",
    """SELECT call_id, frame_idx, channel, round(fc, 6) AS freq_hz, round(re, 6) + 0e0 AS re, round(im, 6) + 0e0 AS im, round(sqrt(re * re + im * im), 6) + 0e0 AS magnitude
   FROM f_co JOIN f_ch USING (channel)""",
    **coeff_ctes(False),
)
def _(t):
    path = scratch_table(t.spark, "filterbank")
    SO.write_fb_store(t.waveform, path, FBC)
    df = t.spark.read.parquet(path).filter("representation = 'filterbank'")
    return rounded(df.select("call_id", "frame_idx", "channel", "freq_hz", "re", "im", "magnitude"))


def store_meta(t):
    """One metadata row per supplier nation: parameters drawn from the supplier table."""
    s = t.raw("supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.max("s_suppkey").alias("k"))
    return s.select(
        F.concat(F.lit("stft_"), F.col("s_nationkey")).alias("repr_id"),
        F.when(F.col("s_nationkey") % 5 == 4, "other").otherwise("stft").alias("representation"),
        F.create_map(
            F.lit("sr"),
            F.lit("16000.0"),
            F.lit("stride"),
            F.when(F.col("n") > 3, "256").otherwise("320"),
            F.lit("scale"),
            F.when(F.col("k") % 2 == 0, "mel").otherwise("erb"),
        ).alias("parameters"),
    )


@query(
    "S9_meta_roundtrip",
    """SELECT 'stft_' || s_nationkey AS repr_id, CASE WHEN s_nationkey % 5 = 4 THEN 'other' ELSE 'stft' END AS representation, '16000.0' AS sr,
   CASE WHEN count(*) > 3 THEN '256' ELSE '320' END AS stride, CASE WHEN max(s_suppkey) % 2 = 0 THEN 'mel' ELSE 'erb' END AS scale FROM supplier GROUP BY s_nationkey""",
)
def _(t):
    path = scratch_table(t.spark, "meta")
    store_meta(t).write.json(path)
    m = SO.read_meta(t.spark, path)
    return m.select("repr_id", "representation", *[F.col("parameters")[k].alias(k) for k in ("sr", "stride", "scale")])


@query(
    "S10_find_store",
    """SELECT repr_id FROM (SELECT 'stft_' || s_nationkey AS repr_id, count(*) AS n, max(s_suppkey) AS k FROM supplier WHERE s_nationkey % 5 <> 4 GROUP BY s_nationkey)
   WHERE n > 3 AND k % 2 = 0 ORDER BY CASE WHEN repr_id = 'stft_999' THEN 0 ELSE 1 END, repr_id LIMIT 1""",
)
def _(t):
    return SO.find_store(store_meta(t), "stft", {"sr": 16000, "stride": 256, "scale": "mel"}, "stft_999")


@query(
    "S10_matching_stores",
    """SELECT repr_id FROM (SELECT 'stft_' || s_nationkey AS repr_id, count(*) AS n, max(s_suppkey) AS k FROM supplier WHERE s_nationkey % 5 <> 4 GROUP BY s_nationkey)
   WHERE n > 3 AND k % 2 = 0""",
)
def _(t):
    return SO.matching_stores(store_meta(t), "stft", {"sr": 16000, "stride": 256, "scale": "mel"}).select("repr_id")


@query(
    "S11_missing_calls",
    "SELECT doc_id AS call_id, n_chars / 1e3 AS duration FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def _(t):
    done = t.raw("labels").filter("quality = 1").select(F.col("doc_id").alias("call_id"))
    return SO.missing_calls(t.duration, done)


@query(
    "S11_from_ordinal",
    "SELECT call_id, duration FROM (SELECT *, row_number() OVER (ORDER BY call_id) AS rn FROM duration) WHERE rn >= 40",
)
def _(t):
    return SO.from_ordinal(t.duration, 40)


@query(
    "S11_from_ordinal_text",
    "SELECT call_id, duration FROM (SELECT call_id || '-' || chr(CAST(97 + call_id % 3 AS INT)) AS call_id, duration, row_number() OVER (ORDER BY call_id || '-' || chr(CAST(97 + call_id % 3 AS INT))) AS rn FROM duration) WHERE rn >= 40",
)
def _(t):
    text = F.concat(F.col("call_id").cast("string"), F.lit("-"), F.char(97 + F.col("call_id") % 3))
    return SO.from_ordinal(t.duration.withColumn("call_id", text), 40)


@query(
    "S12_write_contours",
    "SELECT call_id, frame_idx, printf('%.3f', time) AS time, printf('%.3f', frequency) AS frequency, 'realigned' AS version FROM contour",
)
def _(t):
    path = scratch_table(t.spark, "contour-csv")
    rows = t.contour.select("call_id", "frame_idx", "time", "frequency", F.lit("realigned").alias("version"))
    SO.write_contours(rows, path, decimals=3)
    back = t.spark.read.option("header", True).csv(path)
    return back.select(
        F.col("call_id").cast("bigint").alias("call_id"),
        F.col("frame_idx").cast("int").alias("frame_idx"),
        "time",
        "frequency",
        "version",
    )


@query(
    "S13_union_versions",
    """SELECT version, count(*) AS n, count(confidence) AS with_confidence, round(sum(frequency), 4) + 0e0 AS total FROM
   (SELECT 'extracted' AS version, frequency, confidence FROM contour UNION ALL SELECT 'corrected', frequency, NULL FROM contour_ref
    UNION ALL SELECT 'shifted', frequency + 1e0, confidence FROM contour) GROUP BY 1""",
)
def _(t):
    base = t.contour.withColumn("version", F.lit("extracted"))
    fixed = t.contour_ref.withColumn("version", F.lit("corrected"))
    shifted = base.withColumn("version", F.lit("shifted")).withColumn("frequency", F.col("frequency") + 1.0)
    points = t.correction.withColumn("version", F.lit("points"))
    u = SO.union_versions(base, fixed, shifted, base, points)
    return u.groupBy("version").agg(
        F.count(F.lit(1)).alias("n"), F.count("confidence").alias("with_confidence"), r6(F.sum("frequency"), 4).alias("total")
    )


@query(
    "S15_run_report",
    """SELECT CASE WHEN l.toxic = 1 THEN 'failed' WHEN l.toxic = 0 THEN 'ok' ELSE 'skipped' END AS status, count(*) AS calls FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1""",
)
def _(t):
    lab = t.raw("labels").select(F.col("doc_id").alias("call_id"), "toxic")
    good, bad = SO.split_valid(lab, F.col("toxic") == 0)
    return SO.report_counts(SO.run_report(t.duration, good, bad))


_EX = J.ExtractConfig(
    method="stft", sr=SR, n_fft=256, frame_resolution=0.064, ridge=J.TR.RidgeConfig(f1_min=22.5, f1_max=90.0, max_jump=12.0)
)


@query("P18_extract_dataset", "SELECT 'ok' AS status, count(DISTINCT call_id) AS calls FROM sample")
def _(t):
    """Two runs into one sink: the second finds nothing missing and reports the same calls."""
    sink = scratch_table(t.spark, "extracted")
    J.extract_dataset(t.spark, t.waveform, sink, _EX)
    return SO.report_counts(J.extract_dataset(t.spark, t.waveform, sink, _EX))


@query("K9_cluster_job")
def _(t):
    return J.cluster_contours_job(t.spark, t.contour, points=16).cluster_contours.select(
        "cluster", "pos", r6("mean").alias("mean"), r6("std").alias("std"), "n"
    )


@query("S16_write_assignments")
def _(t):
    sink = scratch_table(t.spark, "assignments")
    J.cluster_contours_job(t.spark, t.contour, sink, points=16)
    return t.spark.read.option("header", True).csv(sink)


