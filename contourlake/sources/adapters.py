"""Deterministic adapters from the driver tables to the engine's own schemas.

Every adapter bounds the size of one call by construction and never by dropping rows: rows are first
combined into cells of a fixed grid (with map-side partial aggregation, so a key that holds a third of
the table costs one partial row per task), and only the bounded cells are grouped per call.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TF_CHANNELS = 50
TF_DT = 5e-2
TF_AXIS = [17.0 + 1.3 * c for c in range(TF_CHANNELS)]
CONTOUR_DT = 1.6e-2
SAMPLE_RATE = 1000
VECTORS_PER_CALL = 50


@dataclass
class Tables:
    """Lazy access to one folder of driver tables and the derived call tables."""

    spark: SparkSession
    path: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def tf_frame(self) -> DataFrame:
        """(call_id, frame_idx, time, mags): supplier x half-year x part-channel price mass.

        One conditional aggregate per channel gives the dense frame in a single shuffle.
        """
        cells = self.raw("lineitem").select(
            F.col("l_suppkey").alias("call_id"),
            F.floor(F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")) / 180).cast("int").alias("b"),
            (F.col("l_partkey") % TF_CHANNELS).cast("int").alias("channel"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        )
        total = "coalesce(sum(CASE WHEN channel = {c} THEN cents END), 0L)"
        wide = cells.groupBy("call_id", "b").agg(
            *[F.expr(f"{total.format(c=c)} AS m{c}") for c in range(TF_CHANNELS)]
        )
        mags = F.expr("array(" + ",".join(f"m{c} / 1e5D" for c in range(TF_CHANNELS)) + ")")
        order = W.partitionBy("call_id").orderBy("b")
        return wide.select("call_id", (F.row_number().over(order) - 1).alias("frame_idx"), mags.alias("mags")).select(
            "call_id", "frame_idx", (F.col("frame_idx") * TF_DT).alias("time"), "mags"
        )

    @cached_property
    def tf(self) -> DataFrame:
        """Long grid (call_id, frame_idx, time, channel, freq_hz, magnitude)."""
        return self.tf_frame.select(
            "call_id", "frame_idx", "time", F.posexplode("mags").alias("channel", "magnitude")
        ).select(
            "call_id",
            "frame_idx",
            "time",
            "channel",
            (17.0 + 1.3 * F.col("channel")).alias("freq_hz"),
            "magnitude",
        )

    @cached_property
    def tf_call(self) -> DataFrame:
        """One row per call: (call_id, frames ARRAY<ARRAY<DOUBLE>>)."""
        packed = F.sort_array(F.collect_list(F.struct("frame_idx", "mags")))
        return self.tf_frame.groupBy("call_id").agg(F.transform(packed, lambda s: s["mags"]).alias("frames"))

    @cached_property
    def event_frames(self) -> DataFrame:
        """Events combined per (call, 8-hour slot) and numbered; a call is one user within 30 days."""
        day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
        ev = self.raw("events").select(
            (F.col("user_id") + 1_000_000 * F.floor(day / 30).cast("bigint")).alias("call_id"),
            F.floor((day * 24 + F.hour("ts")) / 8).cast("int").alias("slot"),
            "event_id",
            "event_type",
            "value",
        )
        slots = ev.groupBy("call_id", "slot").agg(
            F.max("value").alias("v"),
            F.max("event_id").alias("e"),
            F.max("event_type").alias("kind"),
            F.min("event_type").alias("low_kind"),
        )
        order = W.partitionBy("call_id").orderBy("slot")
        return slots.withColumn("frame_idx", F.row_number().over(order) - 1)

    def _wrapped(self):
        return F.lit(17.0) + F.col("v") - F.floor(F.col("v") / 65.0) * 65.0

    @cached_property
    def contour(self) -> DataFrame:
        """(call_id, frame_idx, time, frequency, confidence); slots holding only errors are unvoiced."""
        return self.event_frames.select(
            "call_id",
            "frame_idx",
            (F.col("frame_idx") * CONTOUR_DT).alias("time"),
            F.when(F.col("kind") == "error", F.lit(0.0)).otherwise(F.round(self._wrapped(), 6)).alias("frequency"),
            F.round(F.col("v") / (F.col("v") + 50.0), 6).alias("confidence"),
        )

    @cached_property
    def contour_ref(self) -> DataFrame:
        """Second version of the same calls with start/end markers (two end marks on purpose)."""
        drift = F.lit(1.0) + 1e-2 * ((F.col("e") % 7) - 3)
        return self.event_frames.select(
            "call_id",
            "frame_idx",
            (F.col("frame_idx") * CONTOUR_DT).alias("time"),
            F.when(F.col("kind") == "error", F.lit(0.0))
            .otherwise(F.round(self._wrapped() * drift, 6))
            .alias("frequency"),
            F.when(F.col("frame_idx") == 5, 1).otherwise(0).alias("start_point"),
            F.when(F.col("frame_idx").isin(35, 40), 1).otherwise(0).alias("end_point"),
        )

    @cached_property
    def correction(self) -> DataFrame:
        """(call_id, time, freq): large purchase-only slots act as hand-placed points."""
        big = (F.col("low_kind") == "purchase") & (F.col("v") >= 60.0)
        return self.event_frames.filter(big).select(
            "call_id",
            (F.col("frame_idx") * CONTOUR_DT).alias("time"),
            F.round(20.0 + F.col("v") - F.floor(F.col("v") / 40.0) * 40.0, 6).alias("freq"),
        )

    @cached_property
    def waveform(self) -> DataFrame:
        """(call_id, sr, samples): blocks of consecutive vectors joined end to end."""
        packed = F.sort_array(F.collect_list(F.struct("vec_id", "embedding")))
        return (
            self.raw("embeddings")
            .groupBy(F.floor(F.col("vec_id") / VECTORS_PER_CALL).cast("bigint").alias("call_id"))
            .agg(F.flatten(F.transform(packed, lambda s: s["embedding"])).cast("array<double>").alias("samples"))
            .select("call_id", F.lit(SAMPLE_RATE).alias("sr"), "samples")
        )

    @cached_property
    def sample(self) -> DataFrame:
        """Long samples (call_id, n, x); no shuffle, the position follows from the vector number."""
        return self.raw("embeddings").select(
            F.floor(F.col("vec_id") / VECTORS_PER_CALL).cast("bigint").alias("call_id"),
            (F.col("vec_id") % VECTORS_PER_CALL).alias("r"),
            F.posexplode("embedding").alias("i", "x"),
        ).select("call_id", (F.col("r") * 64 + F.col("i")).cast("int").alias("n"), F.col("x").cast("double").alias("x"))

    @cached_property
    def duration(self) -> DataFrame:
        return self.raw("documents").select(F.col("doc_id").alias("call_id"), (F.col("n_chars") / 1e3).alias("duration"))

    @cached_property
    def trace_pixels(self) -> DataFrame:
        """(trace_id, x, y): distinct ink pixels on a 120 x 79 canvas, 30 customers per trace."""
        return (
            self.raw("orders")
            .select(
                F.floor(F.col("o_custkey") / 30).cast("bigint").alias("trace_id"),
                (F.col("o_orderkey") % 120).cast("int").alias("x"),
                (F.floor("o_totalprice") % 79).cast("int").alias("y"),
            )
            .distinct()
        )
