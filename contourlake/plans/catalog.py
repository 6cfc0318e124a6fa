"""All registered queries."""

from . import q_edit, q_scalar, q_series, q_stats, q_stores, q_track, q_transform  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
