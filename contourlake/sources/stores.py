"""Sources and sinks: contour CSV folders, waveform tables, time-frequency stores and their metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.arrays import dlit
from ..functions.ranks import value_ranks
from ..operators import filterbank as FB
from ..operators import frames as FR

# Fixed names of the frequency column, first hit wins.
FREQUENCY_ALIASES = ("f0_hz", "f0", "frequency")
ASSIGNMENT_COLUMNS = (
    "call_id",
    "version",
    "cluster",
    "x",
    "y",
    "n_points",
    "duration_sec",
    "mean_frequency",
    "std_frequency",
)


# ---------------------------------------------------------------- naming


def norm_version(c: Column | str) -> Column:
    """Lower, trim, dashes to underscores; blank becomes ``peak``."""
    c = F.col(c) if isinstance(c, str) else c
    v = F.replace(F.trim(F.lower(c)), F.lit("-"), F.lit("_"))
    return F.when(v.isNull() | (v == ""), F.lit("peak")).otherwise(v)


def version_folder(c: Column | str) -> Column:
    return F.concat(F.lit("f0_"), norm_version(c))


def store_name(representation: str, fmax: Column | float) -> Column:
    """``<representation>_<fmax>``; a fractional limit writes ``p`` for the point."""
    fmax = fmax if isinstance(fmax, Column) else F.lit(float(fmax))
    whole = F.when(fmax == F.floor(fmax), fmax.cast("bigint").cast("string")).otherwise(fmax.cast("string"))
    return F.concat(F.lit(representation.strip().lower() + "_"), F.replace(whole, F.lit("."), F.lit("p")))


# ---------------------------------------------------------------- contours


def has_columns(df: DataFrame, cols: Sequence[str]) -> bool:
    return set(cols) <= set(df.columns)


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def frequency_column(columns: Sequence[str], column: str | None = None) -> str:
    """The contour's frequency column; names are compared without case and outer blanks."""
    if column is not None:
        if column not in columns:
            raise ValueError(f"no column {column!r}")
        return column
    normal = {}
    for name in columns:
        normal.setdefault(name.strip().lower(), name)
    for alias in FREQUENCY_ALIASES:
        if alias in normal:
            return normal[alias]
    raise ValueError("could not find a frequency column")


def parse_hz(c: Column) -> Column:
    """Text to Hz: unparsable becomes 0, negative becomes 0."""
    return F.greatest(F.coalesce(c.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def read_contours(spark: SparkSession, path: str, version: str | None = None, column: str | None = None) -> DataFrame:
    """Contour CSV folder of one version.

    The call is the file stem (``<call>.f0.csv``) unless a ``call_id`` column or partition exists.
    Extra columns pass through as text.
    """
    raw = spark.read.option("header", True).csv(path)
    hz = frequency_column(raw.columns, column)
    out = raw
    if "call_id" not in raw.columns:
        # file names arrive percent-encoded; a literal plus must survive the decoding
        name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
        stem = F.regexp_replace(name, r"\.f0\.csv$|\.csv$", "")
        out = raw.select("*", stem.alias("call_id"))
    out = out.withColumn("_hz", parse_hz(F.col(f"`{hz}`"))).drop(hz, "frequency").withColumnRenamed("_hz", "frequency")
    if "time" in out.columns:
        out = out.withColumn("time", F.col("time").try_cast("double"))
    return out.withColumn("version", F.lit(version)) if version is not None else out


def fixed_decimals(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Every floating column as text with a fixed number of decimals."""
    return df.select(
        *[
            F.format_string(f"%.{decimals}f", F.col(c)).alias(c) if t in ("double", "float") else F.col(c)
            for c, t in df.dtypes
        ]
    )


def write_contours(df: DataFrame, path: str, decimals: int = 6, per_call: bool = False, mode: str = "errorifexists") -> None:
    """CSV sink partitioned by version; ``per_call`` adds one folder per call for small exports."""
    keys = ["version"] + (["call_id"] if per_call else [])
    fixed_decimals(df, decimals).write.mode(mode).partitionBy(*keys).option("header", True).csv(path)


def union_versions(primary: DataFrame, corrected: DataFrame, *overlays: DataFrame) -> DataFrame:
    """Primary, corrected and requested overlays in one table.

    Overlays without ``time``/``frequency`` are skipped; overlay versions already present are dropped.
    """
    base = primary.unionByName(corrected, allowMissingColumns=True)
    seen = base.select("call_id", "version").distinct()
    for o in overlays:
        if not has_columns(o, ("time", "frequency")):
            continue
        fresh = o.join(seen, ["call_id", "version"], "left_anti")
        base = base.unionByName(fresh, allowMissingColumns=True)
        seen = base.select("call_id", "version").distinct()
    return base


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Union with one row per call; the lowest row wins so the result does not depend on arrival order."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    rest = [c for c in out.columns if c != "call_id"]
    packed = F.min(F.struct(*rest)).alias("_r")
    return out.groupBy("call_id").agg(packed).select("call_id", "_r.*").select(*out.columns)


# ---------------------------------------------------------------- waveforms and grids


def read_waveforms(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(spark.read.parquet(path), ["call_id", "sr", "samples"])


def write_stft_store(wf: DataFrame, path: str, cfg: FR.MultiResConfig, mode: str = "errorifexists") -> None:
    """Magnitude and decibel grid of the coarse transform, partitioned by representation."""
    axis, _ = FR.stft_axis(cfg.sr, cfg.coarse_n_fft, cfg.fmin, cfg.fmax)
    grid = FR.explode_frames(
        FR.stft(wf, cfg.sr, cfg.coarse_n_fft, cfg.hop, cfg.coarse_win, cfg.fmin, cfg.fmax), axis
    )
    X.to_db(grid).withColumn("representation", F.lit("stft")).write.mode(mode).partitionBy("representation").parquet(path)


def write_fb_store(wf: DataFrame, path: str, cfg: FB.FilterbankConfig, mode: str = "errorifexists") -> None:
    """Complex filterbank coefficients and their magnitudes, partitioned by representation."""
    axis = FB.fb_axis(cfg)
    rows = FB.fb_transform(wf, cfg).select(
        "call_id", "frame_idx", "time", F.posexplode(F.arrays_zip("re", "im", "mags")).alias("channel", "v")
    )
    rows.select(
        "call_id",
        "frame_idx",
        "time",
        "channel",
        F.get(dlit(axis), F.col("channel")).alias("freq_hz"),
        F.col("v.re").alias("re"),
        F.col("v.im").alias("im"),
        F.col("v.mags").alias("magnitude"),
        F.lit("filterbank").alias("representation"),
    ).write.mode(mode).partitionBy("representation").parquet(path)


def magnitude_of(columns: Sequence[str]) -> Column:
    """Magnitude, else from decibels, else from complex parts; whichever columns a store has."""
    options = []
    if "magnitude" in columns:
        options.append(F.col("magnitude"))
    if "db" in columns:
        options.append(F.pow(F.lit(10.0), F.col("db") / 20.0))
    if {"re", "im"} <= set(columns):
        options.append(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))
    if not options:
        raise ValueError("the store has neither magnitude nor db nor complex columns")
    return F.coalesce(*options)


def read_tf(spark: SparkSession, path: str, representation: str, stride: float | None = None, sr: float | None = None) -> DataFrame:
    """Grid of one representation; the partition filter prunes the others before any file is opened."""
    raw = spark.read.parquet(path)
    if "representation" in raw.columns:
        raw = raw.filter(F.col("representation") == representation)
    time = F.col("time") if "time" in raw.columns else F.lit(None).cast("double")
    if stride is not None and sr is not None:
        time = F.coalesce(time, F.col("frame_idx") * stride / sr)
    return raw.select(
        "call_id", "frame_idx", "channel", time.alias("time"), "freq_hz", magnitude_of(raw.columns).alias("magnitude")
    )


def inconsistent_calls(tf: DataFrame, n_channels: int) -> DataFrame:
    """Calls whose cells do not fill frames x channels."""
    sizes = tf.groupBy("call_id").agg(
        F.count(F.lit(1)).alias("cells"), (F.max("frame_idx") + 1).alias("frames"), (F.max("channel") + 1).alias("channels")
    )
    bad = (F.col("cells") != F.col("frames") * n_channels) | (F.col("channels") != n_channels)
    return sizes.filter(bad).select("call_id")


# ---------------------------------------------------------------- metadata


def write_meta(spark: SparkSession, path: str, repr_id: str, representation: str, parameters: Mapping[str, object]) -> None:
    row = [(repr_id, representation, {k: str(v) for k, v in parameters.items() if v is not None})]
    spark.createDataFrame(row, "repr_id string, representation string, parameters map<string,string>").write.mode(
        "append"
    ).json(path)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("repr_id string, representation string, parameters map<string,string>").json(path)


def matching_stores(meta: DataFrame, representation: str, expected: Mapping[str, object]) -> DataFrame:
    """Stores whose parameters all equal the configuration: numbers within 1e-9, text exactly, none missing."""
    ok = F.col("representation") == representation
    for key, value in expected.items():
        have = F.col("parameters")[key]
        if isinstance(value, str):
            same = have == value
        else:
            same = F.abs(have.try_cast("double") - F.lit(float(value))) <= 1e-9
        ok = ok & F.coalesce(same, F.lit(False))
    return meta.filter(ok)


def find_store(
    meta: DataFrame, representation: str, expected: Mapping[str, object], preferred: str, requested: str | None = None
) -> DataFrame:
    """One row: the compatible store, the preferred name first, then by name.

    An explicitly requested store that is present but incompatible is an error.
    """
    good = matching_stores(meta, representation, expected)
    if requested is not None:
        present = meta.filter(F.col("repr_id") == requested).limit(1).count() > 0
        chosen = good.filter(F.col("repr_id") == requested)
        if present and chosen.limit(1).count() == 0:
            raise ValueError(f"the settings recorded for {requested!r} do not fit this transform")
        return chosen.select("repr_id").limit(1)
    return good.orderBy((F.col("repr_id") == preferred).desc(), "repr_id").select("repr_id").limit(1)


# ---------------------------------------------------------------- runs


def missing_calls(src: DataFrame, sink: DataFrame, overwrite: bool = False) -> DataFrame:
    """Calls of the source the sink does not hold yet."""
    return src if overwrite else src.join(sink.select("call_id").distinct(), "call_id", "left_anti")


def from_ordinal(df: DataFrame, start: int) -> DataFrame:
    """Resume at the ``start``-th call (1-based) of the ordered list.

    Calls of any ordered type are ranked by distributed prefix sums; rows without a call are left out.
    """
    if start <= 1:
        return df
    late = value_ranks(df.select("call_id").distinct(), "call_id").filter(F.col("cum") >= start)
    return df.join(late.select(F.col("value").alias("call_id")), "call_id", "left_semi")


def first_n(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """First ``n`` calls in call order after an offset."""
    return df.orderBy("call_id").offset(offset).limit(n)


def sample_calls(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """At most ``k`` calls, repeatable, without replacement: top-k of a seeded MD5 of the call."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("call_id").cast("string")).cast("binary"))
    return df.orderBy(key, "call_id").limit(k)


def split_valid(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Separate rows that may enter grouped work from the quarantined rest."""
    ok = F.coalesce(ok, F.lit(False))
    return df.filter(ok), df.filter(~ok)


def run_report(calls: DataFrame, results: DataFrame, failed: DataFrame) -> DataFrame:
    """One status per call: ok, failed or skipped; with its ``reason`` if ``failed`` tells one."""
    told = ["reason"] if "reason" in failed.columns else []
    r = results.select("call_id").distinct().withColumn("_ok", F.lit(True))
    f = failed.groupBy("call_id").agg(F.lit(True).alias("_bad"), *[F.min(c).alias(c) for c in told])
    joined = calls.select("call_id").distinct().join(r, "call_id", "full_outer").join(f, "call_id", "full_outer")
    status = F.when(F.col("_bad"), "failed").when(F.col("_ok"), "ok").otherwise("skipped")
    return joined.select("call_id", status.alias("status"), *told)


def report_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("calls"))


def write_assignments(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Cluster assignments, nine named columns."""
    df.select(*ASSIGNMENT_COLUMNS).write.mode(mode).option("header", True).csv(path)


def sorted_axis(tf: DataFrame) -> DataFrame:
    """Renumber channels by ascending frequency within each frame."""
    w = W.partitionBy("call_id", "frame_idx").orderBy("freq_hz", "channel")
    return tf.withColumn("channel", F.row_number().over(w) - 1)
