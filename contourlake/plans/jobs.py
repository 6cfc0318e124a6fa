"""Dataset jobs: extract contours for a corpus, cluster contours of a corpus."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster as K
from ..operators import filterbank as FB
from ..operators import frames as FR
from ..operators import hybrid as H
from ..operators import stats as ST
from ..operators import track as TR
from ..session import scratch_table
from ..sources import stores as SO

METHODS = ("stft", "filterbank", "hybrid_stft", "hybrid_filterbank")


@dataclass(frozen=True)
class ExtractConfig:
    """What to extract and with which transforms; every part is configuration-sized."""

    method: str = "hybrid_filterbank"
    sr: int = 16000
    n_fft: int = 8192
    frame_resolution: float = 0.016
    ridge: TR.RidgeConfig = field(default_factory=TR.RidgeConfig)
    hybrid: H.HybridConfig = field(default_factory=H.HybridConfig)
    multires: FR.MultiResConfig = field(default_factory=FR.MultiResConfig)
    fb: FB.FilterbankConfig = field(default_factory=FB.FilterbankConfig)
    min_samples: int = 2
    version: str | None = None

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"method must be one of: {', '.join(METHODS)}")


def unusable(cfg: ExtractConfig) -> Column:
    """Why a call (sr, samples) cannot enter grouped work; null if it can."""
    finite = F.forall("samples", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    return (
        F.when(F.col("samples").isNull(), "the call has no samples")
        .when(F.col("sr").isNull() | (F.col("sr") != cfg.sr), "the sampling rate differs")
        .when(F.size("samples") < cfg.min_samples, f"fewer than {cfg.min_samples} samples")
        .when(~finite, "a sample is not finite")
    )


def _track(wf: DataFrame, cfg: ExtractConfig, store: str | None = None) -> DataFrame:
    if store is not None:
        if cfg.method not in ("filterbank", "hybrid_filterbank"):
            raise ValueError("a store of filterbank grids serves the filterbank methods only")
        hybrid = cfg.hybrid if cfg.method == "hybrid_filterbank" else None
        return extract_from_store(wf.sparkSession, wf, store, cfg.fb, cfg.ridge, hybrid)
    if cfg.method == "stft":
        return TR.track_stft(wf, cfg.sr, cfg.n_fft, None, cfg.frame_resolution, cfg.ridge)
    if cfg.method == "filterbank":
        return TR.track_fb(wf, cfg.fb, cfg.ridge)
    if cfg.method == "hybrid_stft":
        return H.contour_rows(H.track_hybrid_stft(wf, cfg.multires, cfg.hybrid))
    return H.contour_rows(H.track_hybrid_fb(wf, cfg.fb, cfg.hybrid))


def extract_dataset(
    spark: SparkSession,
    src: DataFrame,
    sink: str,
    cfg: ExtractConfig,
    overwrite: bool = False,
    start: int = 1,
    store: str | None = None,
) -> DataFrame:
    """Track every call the sink lacks and append its contour; returns (call_id, status, reason) per call.

    Calls are validated before grouped work, so an unusable one is reported with its reason and never fails the run:
    no samples, another sampling rate, fewer than ``min_samples``, or a sample that is null or not finite (transforms of
    the whole call would spread it).  A call whose contour has no frame of finite frequency and confidence is ``failed``
    too.  Any other call is tracked; one shorter than a hop has a single frame.  With ``store`` the filterbank methods
    take grids from that store and compute only those that it lacks.  The sink is a table partitioned by version; a lost
    executor only repeats its own tasks.
    """
    version = cfg.version or cfg.method
    calls = SO.from_ordinal(src, start)
    if not overwrite and _exists(spark, sink):
        done = spark.read.parquet(sink).filter(F.col("version") == version)
        calls = SO.missing_calls(calls, done)
    judged = calls.withColumn("_reason", unusable(cfg))
    good, bad = SO.split_valid(judged, F.col("_reason").isNull())
    contour = _track(good.drop("_reason"), cfg, store).select("call_id", "frame_idx", "time", "frequency", "confidence")
    out = contour.withColumn("version", F.lit(version))
    writer = out.write.mode("overwrite" if overwrite else "append").partitionBy("version")
    # overwriting replaces this version only
    writer.option("partitionOverwriteMode", "dynamic").parquet(sink)
    written = spark.read.parquet(sink).filter(F.col("version") == version)
    finite = F.max(F.coalesce(F.abs("frequency") + F.abs("confidence") < float("inf"), F.lit(False)))
    silent = written.groupBy("call_id").agg(finite.alias("any")).filter("not any")
    failed = bad.select("call_id", F.col("_reason").alias("reason"))
    return SO.run_report(src, written, failed.union(silent.select("call_id", F.lit("no finite frame"))))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the path itself is there; any other trouble in reading it stays an error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def fill_fb_store(spark: SparkSession, src: DataFrame, store: str, fb: FB.FilterbankConfig) -> DataFrame:
    """Add the filterbank grids of the calls that ``store`` lacks; returns the calls that were added.

    The settings are recorded beside the store at its first use; a store of other settings is an error.
    """
    meta, settings = f"{store}-meta", {k: v for k, v in vars(fb).items()}
    if _exists(spark, meta):
        if SO.matching_stores(SO.read_meta(spark, meta), "filterbank", settings).limit(1).count() == 0:
            raise ValueError(f"the store {store} was written with other settings")
    else:
        SO.write_meta(spark, meta, "filterbank", "filterbank", settings)
    new = src
    if _exists(spark, store):
        path = scratch_table(spark, "missing")  # the list must not change while the store grows
        have = spark.read.parquet(store).filter("representation = 'filterbank'")
        SO.missing_calls(src.select("call_id"), have).write.parquet(path)
        missing = spark.read.parquet(path)
        new = src.join(missing, "call_id", "left_semi")
    else:
        missing = src.select("call_id")
    SO.write_fb_store(new, store, fb, mode="append")
    return missing


def extract_from_store(
    spark: SparkSession,
    src: DataFrame,
    store: str,
    fb: FB.FilterbankConfig,
    ridge: TR.RidgeConfig = TR.RidgeConfig(),
    hybrid: H.HybridConfig | None = None,
) -> DataFrame:
    """Contours of ``src`` from stored filterbank grids: only grids that the store lacks are computed.

    The ridge tracker is used, or the hybrid one if its settings are given.
    """
    fill_fb_store(spark, src, store, fb)
    grid = SO.read_tf(spark, store, "filterbank", fb.stride, fb.sr).join(src.select("call_id").distinct(), "call_id", "left_semi")
    if hybrid is not None:
        return H.contour_rows(H.track_hybrid(FR.pack_calls(FR.pack_frames(grid)), FB.fb_axis(fb), hybrid))
    return TR.track_store(grid, FB.fb_axis(fb), ridge)


@dataclass(frozen=True)
class ClusterResult:
    assignments: DataFrame
    cluster_contours: DataFrame
    silhouette: DataFrame


def cluster_contours_job(
    spark: SparkSession,
    contour: DataFrame,
    sink: str | None = None,
    points: int = 128,
    mode: str = "balanced",
    k: int = 4,
    seed: int = 0,
    version: str = "corrected",
    squared: bool = True,
) -> ClusterResult:
    """Usable contours -> features -> standardised -> 2-D -> k-means -> score -> assignments and mean contours.

    Features are read several times (moments, components, k-means passes), so they are written once to the
    shared folder; that also cuts the lineage.  The score is the squared-distance silhouette, which is linear in
    the calls; ``squared=False`` asks for the Euclidean one, which compares all pairs.
    """
    path = scratch_table(spark, "features")
    K.contour_features(K.resample_contour(K.usable_contours(contour), points), mode).write.parquet(path)
    feats = spark.read.parquet(path)
    labelled = K.kmeans(K.embed2d(K.standardise(feats)), k, seed)
    path = scratch_table(spark, "labels")
    labelled.drop("features").write.parquet(path)
    labelled = spark.read.parquet(path)
    assignments = labelled.withColumn("version", F.lit(version)).select(*SO.ASSIGNMENT_COLUMNS)
    if sink is not None:
        SO.write_assignments(assignments, sink)
    score = K.silhouette_squared(labelled) if squared else K.silhouette(labelled)
    return ClusterResult(
        assignments, ST.cluster_contours(labelled.select("call_id", "contour"), labelled), K.mean_silhouette(score)
    )
