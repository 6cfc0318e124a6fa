"""Contour clustering: features, standardisation, embedding, neighbours, k-means, silhouette."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import exprs as X
from ..functions import series as R
from ..session import scratch_table

MODES = ("balanced", "frequency_main", "modulation_main")


def usable_contours(contour: DataFrame) -> DataFrame:
    """Calls with at least two voiced points: (call_id, time, f0) arrays in time order.

    A contour without a time column is ordered by frame and uses the frame number.
    """
    c = contour if "time" in contour.columns else contour.withColumn("time", F.col("frame_idx").cast("double"))
    v = c.select("call_id", "frame_idx", F.col("time").cast("double").alias("time"), X.h1_to_f0("frequency").alias("f0"))
    v = v.filter(X.voiced("f0") & X.finite("time"))
    packed = F.sort_array(F.collect_list(F.struct("time", "frame_idx", "f0")))
    calls = v.groupBy("call_id").agg(packed.alias("p")).filter(F.size("p") >= 2)
    return calls.select(
        "call_id", F.transform("p", lambda s: s["time"]).alias("time"), F.transform("p", lambda s: s["f0"]).alias("f0")
    )


def resample_contour(calls: DataFrame, n: int = 128) -> DataFrame:
    """Add ``contour``: F0 at ``n`` points of normalised time (index spacing when the duration is 0)."""
    if n < 2:
        raise ValueError("the target length must be at least 2")
    t0 = F.get("time", F.lit(0))
    span = F.element_at("time", -1) - t0

    def axis(s: Column) -> Column:
        return F.transform(
            s["t"],
            lambda x, i: F.when(s["d"] > 0, (x - s["z"]) / F.when(s["d"] > 0, s["d"])).otherwise(
                i / (F.size(s["t"]) - 1).cast("double")
            ),
        )

    source = A.let(F.struct(F.col("time").alias("t"), span.alias("d"), t0.alias("z")), axis)
    targets = A.dlit([i / (n - 1) for i in range(n)])
    return calls.withColumn("contour", R.interp_all(targets, source, F.col("f0")))


def contour_features(calls: DataFrame, mode: str = "balanced") -> DataFrame:
    """Feature vector of resampled calls: shape, modulation or curvature parts plus a level summary."""
    log_f = F.transform("contour", lambda f: F.log2(F.greatest(f, F.lit(1e-6))))
    mean = A.array_mean(F.col("f0"))
    std = A.let(
        F.col("f0"),
        lambda v: A.let(
            A.array_mean(v), lambda m: F.sqrt(A.array_mean(F.transform(v, lambda x: (x - m) * (x - m))))
        ),
    )
    c = calls.select(
        "call_id",
        "contour",
        log_f.alias("_log"),
        F.size("f0").cast("bigint").alias("n_points"),
        (F.element_at("time", -1) - F.get("time", F.lit(0))).alias("duration_sec"),
        mean.alias("mean_frequency"),
        std.alias("std_frequency"),
    ).withColumn("_shape", R.zscore(F.col("_log")))
    level = [F.col("mean_frequency"), F.col("std_frequency"), F.col("duration_sec")]
    times = lambda a, k: F.transform(a, lambda x: x * k)
    mod = R.diff0(F.col("_shape"))
    if mode == "frequency_main":
        parts = F.concat(F.col("_log"), times(mod, 0.25), F.array(*level))
    elif mode == "modulation_main":
        weak = F.array(level[0] * 0.2, level[1] * 0.5, level[2])
        parts = F.concat(mod, times(R.diff0(mod), 0.6), weak)
    elif mode == "balanced":
        parts = F.concat(F.col("_shape"), F.array(*level))
    else:
        raise ValueError(f"mode must be one of: {', '.join(MODES)}")
    return c.withColumn("features", parts).drop("_log", "_shape")


def standardise(features: DataFrame, col: str = "features") -> DataFrame:
    """Column-wise (x - mean) / population deviation; constant columns are only centred.

    Moments are partial aggregates per position; their single result row is broadcast.
    """
    moments = (
        features.select(F.posexplode(col).alias("pos", "x"))
        .groupBy("pos")
        .agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "m", "s"))).alias("_mom"))
    )
    z = F.zip_with(
        col, "_mom", lambda x, m: (x - m["m"]) / F.when(m["s"] > 0, m["s"]).otherwise(F.lit(1.0))
    )
    return features.join(F.broadcast(moments)).withColumn(col, z).drop("_mom")


def neighbour_count(k: int, n: int) -> int:
    """Limit a neighbour or cluster count to [2, n - 1]."""
    return min(max(2, k), n - 1)


def embed2d(features: DataFrame, col: str = "features") -> DataFrame:
    """Two principal components as (x, y); each axis points toward its largest loading."""
    vec = features.withColumn("_v", array_to_vector(col))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(vec)
    load = model.pc.toArray()
    sign = [1.0 if load[np.argmax(np.abs(load[:, j])), j] >= 0 else -1.0 for j in range(2)]
    out = model.transform(vec).withColumn("_a", vector_to_array("_p"))
    return out.select(
        *[c for c in features.columns],
        (F.get("_a", F.lit(0)) * sign[0]).alias("x"),
        (F.get("_a", F.lit(1)) * sign[1]).alias("y"),
    )


def kmeans(emb: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Add ``cluster`` from k-means on (x, y); at least three calls are needed."""
    n = emb.count()
    if n < 3:
        raise ValueError(f"need at least 3 usable calls for clustering, found {n}")
    vec = emb.withColumn("_v", array_to_vector(F.array("x", "y")))
    model = KMeans(k=neighbour_count(k, n), seed=seed, featuresCol="_v", predictionCol="cluster").fit(vec)
    return model.transform(vec).drop("_v")


# ---------------------------------------------------------------- exact neighbours

BLOCK_ROWS = 2000
#: Rows of a block of neighbours: two blocks of vectors and 256 rows of distances are held, so blocks can be larger.
KNN_ROWS = 8000


def _pivots(features: DataFrame, col: str, m: int) -> np.ndarray:
    """A fixed number of rows, repeatable, used only to partition the space."""
    rows = features.orderBy(F.xxhash64("call_id"), "call_id").limit(m).select(col).collect()
    return np.array([r[0] for r in rows], dtype=float)


def knn(features: DataFrame, k: int, col: str = "features", pivots: int = 64, block_rows: int = KNN_ROWS) -> DataFrame:
    """Exact k nearest other calls: (call_id, rank, neighbour, distance).

    Calls are placed in the cell of their nearest pivot.  Cell radii and counts bound each call's k-th
    distance from above, and the triangle inequality then rules cells out; only the remaining cells are
    searched, so pruning never changes the answer.  A crowded cell is split into blocks of about
    ``block_rows`` members, and the calls visiting it likewise, so one task compares two bounded blocks and
    returns at most k rows per visiting call.
    """
    # read by the pivots and the cells: computed once
    spark = features.sparkSession
    path = scratch_table(spark, "knn-features")
    features.select("call_id", col).write.parquet(path)
    features = spark.read.parquet(path)
    piv = _pivots(features, col, pivots)
    m = len(piv)

    def assign(batches):
        for pdf in batches:
            x = np.stack([np.asarray(v, dtype=float) for v in pdf[col]])
            d = np.sqrt(np.maximum(((x[:, None, :] - piv[None, :, :]) ** 2).sum(axis=2), 0.0))
            yield pd.DataFrame(
                {"call_id": pdf["call_id"], "vec": list(x), "cell": d.argmin(axis=1).astype(np.int32), "dist": list(d)}
            )

    placed = features.select("call_id", col).mapInPandas(
        assign, "call_id bigint, vec array<double>, cell int, dist array<double>"
    )
    # read by the cell statistics, the visits and the members: written once to the shared folder
    path = scratch_table(spark, "knn-cells")
    placed.write.parquet(path)
    placed = spark.read.parquet(path)
    cells = (
        placed.groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.get("dist", F.col("cell"))).alias("radius"))
        .agg(F.collect_list(F.struct("cell", "n", "radius")).alias("cells"))
    )
    located = placed.join(F.broadcast(cells))

    # upper bound of the k-th distance: cells by farthest possible member until k + 1 members are covered
    far = F.array_sort(
        F.transform(
            "cells", lambda c: F.struct((F.get("dist", c["cell"]) + c["radius"]).alias("far"), c["n"].alias("n"))
        )
    )
    start = F.struct(F.lit(0).cast("bigint").alias("got"), F.lit(None).cast("double").alias("ub"))
    bound = F.aggregate(
        far,
        start,
        lambda s, c: F.struct(
            (s["got"] + c["n"]).alias("got"), F.when(s["got"] > k, s["ub"]).otherwise(c["far"]).alias("ub")
        ),
        lambda s: s["ub"],
    )
    visits = located.withColumn("_ub", bound).select(
        "call_id",
        "vec",
        F.explode(
            F.filter(
                "cells",
                lambda c: F.get("dist", c["cell"]) - c["radius"] <= F.col("_ub") * (1.0 + 1e-9) + 1e-9,
            )
        ).alias("c"),
    )
    seen = visits.groupBy(F.col("c.cell").alias("cell")).agg(F.count(F.lit(1)).alias("visitors"))
    blocks_of = lambda n: F.ceil(n / float(block_rows)).cast("int")
    spread = lambda n, salt: F.pmod(F.xxhash64("call_id", F.lit(salt)), n.cast("bigint")).cast("int")
    member_size = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("members"))
    sizes = member_size.join(seen, "cell", "left").select(
        "cell", blocks_of(F.col("members")).alias("mb"), F.greatest(blocks_of(F.coalesce("visitors", F.lit(1))), F.lit(1)).alias("vb")
    )
    members = (
        placed.join(F.broadcast(sizes), "cell")
        .withColumn("m", spread(F.col("mb"), 1))
        .withColumn("v", F.explode(F.sequence(F.lit(0), F.col("vb") - 1)))
        .select(*[F.col(c).alias(f"r_{c}") for c in ("cell", "m", "v", "call_id", "vec")])
    )
    queries = (
        visits.select("call_id", "vec", F.col("c.cell").alias("cell"))
        .join(F.broadcast(sizes), "cell")
        .withColumn("v", spread(F.col("vb"), 2))
        .withColumn("m", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)))
        .select("cell", "m", "v", "call_id", "vec")
    )

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"call_id": [], "neighbour": [], "distance": []})
        if left.empty or right.empty:
            return empty
        q, r = np.stack(list(left["vec"])), np.stack(list(right["r_vec"]))
        qi, ri = left["call_id"].to_numpy(), right["r_call_id"].to_numpy()
        q_good, r_good = np.isfinite(q).all(axis=1), np.isfinite(r).all(axis=1)  # others are at no finite distance
        q, qi, r, ri = q[q_good], qi[q_good], r[r_good], ri[r_good]
        if not len(q) or not len(r):
            return empty
        # products of matrices find the rows that can be among the k nearest; those are measured by differences
        centre = r.mean(axis=0)
        qc, rc = q - centre, r - centre
        q2, r2 = (qc * qc).sum(axis=1), (rc * rc).sum(axis=1)
        slack = 1e-9 * (q2 + r2.max())
        out_q, out_r, out_d = [], [], []
        for a in range(0, len(q), 256):
            ids = qi[a : a + 256]
            rough = q2[a : a + 256, None] + r2 - 2.0 * (qc[a : a + 256] @ rc.T)
            rough[ids[:, None] == ri[None, :]] = np.inf
            kth = np.partition(rough, k - 1, axis=1)[:, k - 1] if k < len(r) else np.full(len(ids), np.inf)
            row, at = np.nonzero((rough <= (kth + 2.0 * slack[a : a + 256])[:, None]) & np.isfinite(rough))
            d = np.concatenate([np.zeros(0), *(
                np.sqrt(((q[a + row[i : i + 4096]] - r[at[i : i + 4096]]) ** 2).sum(axis=1)) for i in range(0, len(row), 4096)
            )])
            order = np.lexsort((ri[at], d, row))
            row, at, d = row[order], at[order], d[order]
            ok = np.isfinite(d) & (np.arange(len(row)) - np.searchsorted(row, row) < k)
            out_q.append(ids[row[ok]])
            out_r.append(ri[at[ok]])
            out_d.append(d[ok])
        return pd.DataFrame(
            {"call_id": np.concatenate(out_q), "neighbour": np.concatenate(out_r), "distance": np.concatenate(out_d)}
        )

    key = ("cell", "m", "v")
    partial = (
        queries.groupBy(*key)
        .cogroup(members.groupBy(*[f"r_{c}" for c in key]))
        .applyInPandas(compare, "call_id bigint, neighbour bigint, distance double")
    )
    ranked = F.slice(F.sort_array(F.collect_list(F.struct("distance", "neighbour"))), 1, k)
    return (
        partial.groupBy("call_id")
        .agg(ranked.alias("best"))
        .select("call_id", F.posexplode("best").alias("rank", "b"))
        .select("call_id", (F.col("rank") + 1).alias("rank"), F.col("b.neighbour").alias("neighbour"), F.col("b.distance").alias("distance"))
    )


# ---------------------------------------------------------------- silhouette


def silhouette(emb: DataFrame, cluster: str = "cluster", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Euclidean silhouette per call: (call_id, cluster, silhouette); 0 in a cluster of one.

    Mean Euclidean distances are pairwise by definition.  Calls are split by hash into blocks; every pair of
    blocks is one bounded task that returns per call the distance sum to each cluster, never the pairs.
    ``silhouette_squared`` is the linear-time form for large corpora.
    """
    pts = emb.select("call_id", "x", "y", F.col(cluster).cast("int").alias("cluster"))
    blocks = max(1, math.ceil(pts.count() / block_rows))
    home = F.pmod(F.xxhash64("call_id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = pts.withColumn("a", home).withColumn("b", every)
    right = pts.withColumn("b", home).withColumn("a", every)

    def sums(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if p.empty or q.empty:
            return pd.DataFrame({"call_id": [], "own": [], "other": [], "total": []})
        d = np.hypot(p["x"].to_numpy()[:, None] - q["x"].to_numpy(), p["y"].to_numpy()[:, None] - q["y"].to_numpy())
        labels, code = np.unique(q["cluster"].to_numpy(), return_inverse=True)
        total = np.stack([d[:, code == i].sum(axis=1) for i in range(len(labels))], axis=1)
        return pd.DataFrame(
            {
                "call_id": np.repeat(p["call_id"].to_numpy(), len(labels)),
                "own": np.repeat(p["cluster"].to_numpy(), len(labels)),
                "other": np.tile(labels, len(p)),
                "total": total.ravel(),
            }
        )

    part = (
        left.groupBy("a", "b")
        .cogroup(right.groupBy("a", "b"))
        .applyInPandas(sums, "call_id bigint, own int, other int, total double")
    )
    per = part.groupBy("call_id", "own", "other").agg(F.sum("total").alias("total"))
    return _silhouette_from_sums(per, pts)


def silhouette_squared(emb: DataFrame, cluster: str = "cluster") -> DataFrame:
    """The same with squared distances, from cluster moments: one row per cluster is broadcast."""
    pts = emb.select("call_id", "x", "y", F.col(cluster).cast("int").alias("cluster"))
    mom = pts.groupBy(F.col("cluster").alias("other")).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("x").alias("sx"),
        F.sum("y").alias("sy"),
        F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("sq"),
    )
    packed = mom.agg(F.collect_list(F.struct("other", "k", "sx", "sy", "sq")).alias("_m"))
    rows = pts.join(F.broadcast(packed)).select("call_id", "x", "y", F.col("cluster").alias("own"), F.explode("_m").alias("m"))
    r2 = F.col("x") * F.col("x") + F.col("y") * F.col("y")
    total = F.col("m.k") * r2 - 2.0 * (F.col("x") * F.col("m.sx") + F.col("y") * F.col("m.sy")) + F.col("m.sq")
    return _silhouette_from_sums(rows.select("call_id", "own", F.col("m.other").alias("other"), total.alias("total")), pts)


def _silhouette_from_sums(per: DataFrame, pts: DataFrame) -> DataFrame:
    sizes = pts.groupBy(F.col("cluster").alias("other")).agg(F.count(F.lit(1)).alias("k"))
    j = per.join(F.broadcast(sizes), "other")
    own = F.col("own") == F.col("other")
    s = j.groupBy("call_id", F.col("own").alias("cluster")).agg(
        F.max(F.when(own & (F.col("k") > 1), F.col("total") / F.when(F.col("k") > 1, F.col("k") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("k"))).alias("b"),
    )
    top = F.greatest("a", "b")
    value = F.when(F.col("a").isNull() | F.col("b").isNull() | (top <= 0), F.lit(0.0)).otherwise(
        (F.col("b") - F.col("a")) / F.when(top > 0, top)
    )
    return s.select("call_id", "cluster", value.alias("silhouette"))


def mean_silhouette(sil: DataFrame) -> DataFrame:
    return sil.agg(F.avg("silhouette").alias("silhouette"), F.count(F.lit(1)).alias("calls"))
