import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from contourlake.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("contourlake-tests", "8", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def contour_of(spark):
    """Contour table from {call: [frequency, ...]} at 0.1 s per frame."""

    def make(calls, dt=0.1, **extra):
        rows = []
        for call, freqs in calls.items():
            for i, f in enumerate(freqs):
                rows.append((call, i, i * dt, float(f), *[float(v[call][i]) for v in extra.values()]))
        ddl = "call_id bigint, frame_idx int, time double, frequency double" + "".join(f", {k} double" for k in extra)
        return spark.createDataFrame(rows, ddl)

    return make
