"""Registered queries and their SQL."""

from tracemill.plans import baseline_queries, calibration_queries, event_queries, filter_queries, frame_queries, metadata_queries, motion_queries, pulse_queries, segment_queries, trace_queries, volume_queries  # noqa: F401
from tracemill.plans.registry import QUERIES, SQL  # noqa: F401
