"""Registered queries over the given tables."""

from __future__ import annotations

import importlib

MODULES = [
    "scan_queries", "telemetry_queries", "scoring_queries", "memory_queries", "drift_queries", "graph_queries", "gate_queries",
    "rollup_queries", "stream_queries",
]


def catalogue():
    """(queries, oracles), both keyed by query name."""
    for module in MODULES:
        importlib.import_module(f"lintlake.plans.{module}")
    from lintlake.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
