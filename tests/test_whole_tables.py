"""Queries that have to read every call of their tables."""

import os

import pytest

import __spark_entry__ as entry
from contourlake.plans.base import Tables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are absent")


def test_effective_contour_has_every_call(spark):
    t = Tables(spark, FOLDER)
    got = entry.queries()["J11_effective_contour_all"](spark, FOLDER).filter("call_id >= 0").groupBy("call_id", "source").count().collect()
    calls = {r.call_id for r in t.contour.select("call_id").union(t.contour_ref.select("call_id")).distinct().collect()}
    assert {r.call_id for r in got} == calls
    assert {r.call_id for r in got if r.source == "extracted"} == {c for c in calls if c % 3 == 0}
