"""Registered queries, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

import importlib

MODULES = (
    "relational profiling ingest timeseries evaluation preparation runlog text clusters arrays topics learning"
).split()


def load_all() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        importlib.import_module(f"prismill.plans.{name}")
