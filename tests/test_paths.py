"""Path search by segments against the single pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourlake.operators import hybrid, paths

H1 = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]


@pytest.mark.parametrize("fanout", [2, 8])
def test_segments_give_the_single_pass_path(spark, fanout):
    rnd = np.random.default_rng(3)
    rows, whole = [], []
    for call, (count, tied) in enumerate([(1, False), (2, True), (7, True), (19, False), (11, True)]):
        frames = []
        for segment in range(count):
            size = int(rnd.integers(1, 9))
            part = rnd.integers(0, 3, (size, len(H1))) / 4 if tied else np.round(rnd.normal(size=(size, len(H1))), 3)
            rows.append((call, 5 * segment - 7, part.tolist(), 1))
            frames += part.tolist()
        rows.append((call, 3, [], 1))  # no frames: changes nothing
        whole.append((call, frames))
    rows.append((None, 0, [[0.0] * len(H1)] * 3, 1))
    segments = spark.createDataFrame(rows, "call_id long, segment long, lattice array<array<double>>, idx int").repartition(4)
    got = paths.path_of_segments(segments, H1, 0.5, 1.0, 2.0, fanout=fanout).collect()
    joined = {}
    for r in sorted(got, key=lambda r: (str(r.call_id), r.segment)):
        joined.setdefault(r.call_id, []).extend(r.idx)
    single = spark.createDataFrame([*whole, (None, [[0.0] * len(H1)] * 3)], "call_id long, lattice array<array<double>>")
    want = single.select("call_id", hybrid.viterbi(F.col("lattice"), H1, 0.5, 1.0, 2.0)["idx"].alias("idx")).collect()
    assert joined == {r.call_id: list(r.idx) for r in want}


def test_segments_edge_cases(spark):
    schema = "call_id long, segment long, lattice array<array<double>>"
    assert paths.path_of_segments(spark.createDataFrame([], schema), H1, 0.5, 1.0, 2.0).collect() == []
    twice = spark.createDataFrame([(1, 1, [[0.0] * 7]), (1, 1, [[0.0] * 7])], schema)
    with pytest.raises(ValueError):
        paths.path_of_segments(twice, H1, 0.5, 1.0, 2.0)


def test_max_plus_products_agree_in_any_order():
    rnd = np.random.default_rng(1)
    cost = paths.quantised([0.0, 0.5, 2.0])
    parts = [paths.quantised(rnd.integers(0, 4, (5, 6)) / 8) for _ in range(4)]
    one = [paths.matrix(p, cost, i == 0) for i, p in enumerate(parts)]
    left = paths.composed(paths.composed(paths.composed(one[0], one[1]), one[2]), one[3])
    right = paths.composed(one[0], paths.composed(one[1], paths.composed(one[2], one[3])))
    assert (left == right).all() and (left == paths.matrix(np.concatenate(parts), cost, True)).all()
