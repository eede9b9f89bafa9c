"""Registered queries over the supplied tables."""

from __future__ import annotations

import importlib

from geneweft.plans.registry import QUERIES, SQL

MODULES = ("trajectories", "scores", "parts", "mining", "circuits", "sweeps", "logs", "search", "ingest")


def load_all():
    """Import every module of queries and return (queries, SQL texts)."""
    for name in MODULES:
        importlib.import_module(f"geneweft.plans.{name}")
    return QUERIES, SQL
