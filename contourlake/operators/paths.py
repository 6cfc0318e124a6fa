"""Path search through long recordings: one recording is many tasks, and the path is exact.

A recording's lattice is stored in segments.  What a segment does to the scores of the states is a max-plus matrix; the
matrices are composed by a tree over the segments (up), which gives every segment the scores it starts from (down).
From those each segment finds, for each state at its end, the state at its start; these maps are composed backwards by
the same tree, and every segment traces its own part of the path.

Scores are whole numbers (units of 1e-9), so sums do not depend on the order of composition and ties are real ties:
they go to the highest predecessor and the lowest final state, as in the single pass.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_table
from .hybrid import _costs

UNIT = 1e-9
FANOUT = 8
NEVER = np.iinfo(np.int64).min // 4


def quantised(values: np.ndarray) -> np.ndarray:
    return np.rint(np.asarray(values, float) / UNIT).astype(np.int64)


def step(scores: np.ndarray, frame: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One frame for one or many rows of scores: (scores, predecessor of every state), ties to the highest predecessor."""
    r, n = len(cost) - 1, scores.shape[-1]
    best = np.full(scores.shape, NEVER, np.int64)
    source = np.zeros(scores.shape, np.int32)
    states = np.arange(n, dtype=np.int32)
    for d in range(-r, r + 1):  # ascending predecessors: the last of equal ones stays
        to = slice(max(0, -d), n - max(0, d))
        of = slice(max(0, d), n - max(0, -d))
        moved = scores[..., of] - cost[abs(d)]
        wins = moved >= best[..., to]
        best[..., to] = np.where(wins, moved, best[..., to])
        source[..., to] = np.where(wins, states[of], source[..., to])
    return np.maximum(best + frame, NEVER), source


def matrix(frames: np.ndarray, cost: np.ndarray, first: bool) -> np.ndarray:
    """What a segment does to scores: a row per state before it (one row only for a recording's first segment)."""
    n = frames.shape[1]
    if first:
        scores, frames = frames[:1], frames[1:]
    else:
        scores = np.where(np.eye(n, dtype=bool), 0, NEVER).astype(np.int64)
    for frame in frames:
        scores = step(scores, frame, cost)[0]
    return scores


def composed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return np.stack([np.maximum((row[:, None] + b).max(axis=0), NEVER) for row in a])


def _traced(start: np.ndarray | None, frames: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Scores at a segment's end and the predecessors frame by frame."""
    scores, back = (frames[0], []) if start is None else step(start, frames[0], cost)
    back = [] if start is None else [back]
    for frame in frames[1:]:
        scores, source = step(scores, frame, cost)
        back.append(source)
    return scores, back


def _numbers(raw: bytes, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(-1, width)


def _meet(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Equality join in which nulls meet; the keys stand once."""
    named = right.select(*(F.col(c).alias(f"_{c}" if c in keys else c) for c in right.columns))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return left.join(named, on).drop(*(f"_{c}" for c in keys))


def path_of_segments(
    segments: DataFrame,
    h1: list[float],
    smooth: float,
    scale: float,
    jump: float,
    call_col: str = "call_id",
    segment_col: str = "segment",
    lattice_col: str = "lattice",
    fanout: int = FANOUT,
) -> DataFrame:
    """The best path of every recording, by segments: call, segment, idx (a state per frame).

    ``segments``: a row per segment, numbered upwards from any number without regard to gaps, ``lattice`` its frames.
    Equal to ``hybrid.viterbi`` over the joined frames, for scores that are multiples of 1e-9.  A task holds ``fanout``
    matrices of states x states at most.  Segments without frames have an empty path and change nothing; null calls are
    one recording like any other; repeated segment numbers are refused; an empty table gives no rows; other columns are
    ignored.
    """
    n = len(h1)
    if n < 3:
        raise ValueError("the path search needs at least 3 states")
    cost = quantised(_costs(n, float(np.median(np.diff(h1))), smooth, scale, jump))
    spark, kind = segments.sparkSession, segments.schema[call_col].dataType.simpleString()

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_table(spark, f"paths-{name}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    rows = segments.select(F.col(call_col).alias("call"), F.col(segment_col).cast("long").alias("segment"), F.col(lattice_col).alias("lattice"))
    order = W.partitionBy("call").orderBy("segment")
    empty = rows.filter("lattice is null or size(lattice) = 0").select("call", "segment", F.expr("cast(array() as array<int>)").alias("idx"))
    at = rows.filter("size(lattice) > 0").select("call", "segment").withColumn("at", F.row_number().over(order).cast("long") - 1)
    if not at.groupBy("call", "segment").count().filter("count > 1").isEmpty():
        raise ValueError("a segment number stands twice in one recording")
    parts = stored(_meet(rows.filter("size(lattice) > 0"), at, "call", "segment").select("call", "segment", "lattice", "at"), "segments")

    frames_of = lambda lattice: quantised(np.array([list(f) for f in lattice], float))

    def matrices(batches):
        for pdf in batches:
            made = [matrix(frames_of(x), cost, a == 0).tobytes() for x, a in zip(pdf["lattice"], pdf["at"])]
            yield pd.DataFrame({"call": pdf["call"], "at": pdf["at"], "matrix": made})

    def by_node(level: DataFrame) -> DataFrame:
        return level.withColumn("node", F.floor(F.col("at") / fanout).cast("long"))

    def climb(level: DataFrame, name: str, combine: Callable[[pd.DataFrame], bytes]) -> list[DataFrame]:
        """The levels of the tree; ``combine`` makes a node's value from its children, given in order."""
        levels = [level]
        while not levels[-1].filter("at > 0").isEmpty():

            def run(pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values("at")
                return pd.DataFrame({"call": pdf["call"].iloc[:1], "at": pdf["node"].iloc[:1], "value": [combine(pdf)]})

            up = by_node(levels[-1]).groupBy("call", "node").applyInPandas(run, f"call {kind}, at long, value binary")
            levels.append(stored(up, f"{name}-{len(levels)}"))
        return levels

    def product(pdf: pd.DataFrame) -> bytes:
        values = [_numbers(v, np.int64, n) for v in pdf["value"]]
        total = values[0]
        for value in values[1:]:
            total = composed(total, value)
        return total.tobytes()

    level = stored(parts.select("call", "at", "lattice").mapInPandas(matrices, f"call {kind}, at long, matrix binary").withColumnRenamed("matrix", "value"), "matrices")
    levels = climb(level, "up", product)

    def descend(levels: list[DataFrame], name: str, spread: Callable[[pd.DataFrame, bytes | None], list[bytes | None]]) -> DataFrame:
        """Every leaf's value from outside: ``spread`` gives it to the children of a node that has one."""
        given = levels[-1].select("call", "at", F.lit(None).cast("binary").alias("given"))
        for i, level in enumerate(reversed(levels[:-1])):
            joined = _meet(by_node(level), given.select("call", F.col("at").alias("node"), "given"), "call", "node")

            def run(pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values("at")
                return pd.DataFrame({"call": pdf["call"], "at": pdf["at"], "given": spread(pdf, pdf["given"].iloc[0])})

            given = stored(joined.groupBy("call", "node").applyInPandas(run, f"call {kind}, at long, given binary"), f"{name}-{i}")
        return given

    def starts(pdf: pd.DataFrame, start: bytes | None) -> list[bytes | None]:
        now, out = None if start is None else _numbers(start, np.int64, n), []
        for value in pdf["value"]:
            out.append(None if now is None else now.tobytes())
            value = _numbers(value, np.int64, n)
            now = value if now is None else composed(now, value)
        return out

    begun = stored(_meet(parts, descend(levels, "down", starts), "call", "at").select("call", "segment", "at", "lattice", "given"), "begun")

    def maps(batches):
        for pdf in batches:
            out = []
            for lattice, given in zip(pdf["lattice"], pdf["given"]):
                scores, back = _traced(None if given is None else np.frombuffer(given, np.int64), frames_of(lattice), cost)
                state = np.arange(n, dtype=np.int32)
                for source in reversed(back):
                    state = source[state]
                out.append(np.r_[state, np.int32(np.argmax(scores))].astype(np.int32).tobytes())
            yield pd.DataFrame({"call": pdf["call"], "at": pdf["at"], "value": out})

    # a map's entry: the state at the segment's start (before its first frame) for each at its end, and the best end
    turned = begun.select("call", "at", "lattice", "given").mapInPandas(maps, f"call {kind}, at long, value binary")

    def whole(pdf: pd.DataFrame) -> bytes:
        values = [np.frombuffer(v, np.int32) for v in pdf["value"]]
        state = np.arange(n, dtype=np.int32)
        for value in reversed(values):
            state = value[:n][state]
        return np.r_[state, values[-1][n]].astype(np.int32).tobytes()

    def ends(pdf: pd.DataFrame, end: bytes | None) -> list[bytes | None]:
        values = [np.frombuffer(v, np.int32) for v in pdf["value"]]
        state = values[-1][n] if end is None else np.frombuffer(end, np.int32)[0]
        out = []
        for value in reversed(values):
            out.append(np.int32(state).tobytes())
            state = value[state]
        return out[::-1]

    down = climb(stored(turned, "maps"), "back", whole)
    found = down[0].select("call", "at", F.lit(None).cast("binary").alias("given")) if len(down) == 1 else descend(down, "ends", ends)

    def paths(batches):
        for pdf in batches:
            out = []
            for lattice, given, end in zip(pdf["lattice"], pdf["given"], pdf["end"]):
                scores, back = _traced(None if given is None else np.frombuffer(given, np.int64), frames_of(lattice), cost)
                state = int(np.argmax(scores)) if end is None else int(np.frombuffer(end, np.int32)[0])
                path = [state]
                for source in reversed(back[0 if given is None else 1 :]):
                    state = int(source[state])
                    path.append(state)
                out.append(path[::-1])
            yield pd.DataFrame({"call": pdf["call"], "segment": pdf["segment"], "idx": out})

    found = found.select("call", "at", F.col("given").alias("end"))
    final = _meet(begun, found, "call", "at").select("call", "segment", "lattice", "given", "end")
    traced = final.mapInPandas(paths, f"call {kind}, segment long, idx array<int>")
    return traced.unionByName(empty).select(F.col("call").alias(call_col), F.col("segment").alias(segment_col), "idx")
