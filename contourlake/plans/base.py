"""Query registry: each inventory row pairs a Spark plan with the SQL that states its result."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


@dataclass
class Ctes:
    """Named SQL fragments over the driver tables; ``sql(body)`` pulls in the ones the body names."""

    parts: dict[str, str]

    def sql(self, body: str, **extra: str) -> str:
        parts = {**self.parts, **extra}
        needed: list[str] = []
        started: set[str] = set()

        def visit(text: str) -> None:
            for name, definition in parts.items():
                if name not in started and _mentions(text, name):
                    started.add(name)
                    visit(definition)
                    needed.append(name)

        visit(body)
        kind = lambda n: "" if _mentions(parts[n], n) else "MATERIALIZED "
        head = ",\n".join(f"{n} AS {kind(n)}({parts[n]})" for n in needed)
        return f"WITH RECURSIVE {head}\n{body}" if needed else body


def _mentions(text: str, name: str) -> bool:
    return re.search(rf"\b(FROM|JOIN)\s+{name}\b", text) is not None


# The adapters of ``sources.adapters`` stated in SQL.
CTES = Ctes(
    {
        "t_cell": """SELECT l_suppkey AS call_id,
  CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 18e1) AS INT) AS b,
  CAST(l_partkey % 50 AS INT) AS channel, CAST(sum(CAST(round(l_extendedprice * 1e2) AS BIGINT)) AS BIGINT) AS cents
  FROM lineitem GROUP BY 1, 2, 3""",
        "t_frame": """SELECT call_id, b, CAST(row_number() OVER (PARTITION BY call_id ORDER BY b) - 1 AS INT) AS frame_idx
  FROM (SELECT DISTINCT call_id, b FROM t_cell)""",
        "tf": """SELECT f.call_id, f.frame_idx, f.frame_idx * 5e-2 AS time, c.channel, 1.7e1 + 1.3e0 * c.channel AS freq_hz,
  coalesce(t.cents, 0) / 1e5 AS magnitude
  FROM t_frame f CROSS JOIN (SELECT CAST(range AS INT) AS channel FROM range(50)) c
  LEFT JOIN t_cell t ON t.call_id = f.call_id AND t.b = f.b AND t.channel = c.channel""",
        "ev_slot": """SELECT user_id + 1000000 * CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 3e1) AS BIGINT) AS call_id,
  CAST(floor((date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts)) / 8e0) AS INT) AS slot,
  max(value) AS v, max(event_id) AS e, max(event_type) AS kind, min(event_type) AS low_kind
  FROM events GROUP BY 1, 2""",
        "ev": """SELECT *, CAST(row_number() OVER (PARTITION BY call_id ORDER BY slot) - 1 AS INT) AS frame_idx FROM ev_slot""",
        "contour": """SELECT call_id, frame_idx, frame_idx * 1.6e-2 AS time,
  CASE WHEN kind = 'error' THEN 0e0 ELSE round(1.7e1 + v - floor(v / 6.5e1) * 6.5e1, 6) END AS frequency,
  round(v / (v + 5e1), 6) AS confidence FROM ev""",
        "contour_ref": """SELECT call_id, frame_idx, frame_idx * 1.6e-2 AS time,
  CASE WHEN kind = 'error' THEN 0e0 ELSE round((1.7e1 + v - floor(v / 6.5e1) * 6.5e1) * (1e0 + 1e-2 * ((e % 7) - 3)), 6) END AS frequency,
  CASE WHEN frame_idx = 5 THEN 1 ELSE 0 END AS start_point,
  CASE WHEN frame_idx IN (35, 40) THEN 1 ELSE 0 END AS end_point FROM ev""",
        "correction": """SELECT call_id, frame_idx * 1.6e-2 AS time, round(2e1 + v - floor(v / 4e1) * 4e1, 6) AS freq
  FROM ev WHERE low_kind = 'purchase' AND v >= 6e1""",
        "sample": """SELECT CAST(floor(vec_id / 5e1) AS BIGINT) AS call_id, CAST((vec_id % 50) * 64 + i AS INT) AS n,
  CAST(embedding[i + 1] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings)""",
        "duration": "SELECT doc_id AS call_id, n_chars / 1e3 AS duration FROM documents",
        "trace_pixels": """SELECT DISTINCT CAST(floor(o_custkey / 3e1) AS BIGINT) AS trace_id, CAST(o_orderkey % 120 AS INT) AS x,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 79 AS INT) AS y FROM orders""",
    }
)


def query(name: str, sql: str | None = None, raw: bool = False, **extra: str):
    """Register ``fn(tables)`` under ``name``; the SQL may name any adapter as a table."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if sql is not None:
            ORACLE[name] = sql if raw else CTES.sql(sql, **extra)
        return fn

    return wrap


def r6(c: Column | str, places: int = 6) -> Column:
    """Round for comparison between engines and normalise negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, places) + F.lit(0.0)
