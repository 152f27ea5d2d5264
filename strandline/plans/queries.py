"""All registered queries of the library itself."""

from __future__ import annotations

from . import extra_queries, frame_queries, gaze_queries, more_queries, stream_queries, table_queries
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "extra_queries", "frame_queries", "gaze_queries", "more_queries", "stream_queries", "table_queries"]
