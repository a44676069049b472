"""Registered queries."""

import importlib

MODULES = (
    "signal_queries",
    "evaluation_queries",
    "portfolio_queries",
    "attribution_queries",
    "tick_queries",
    "event_queries",
    "sizing_queries",
    "learning_queries",
    "streaming_queries",
    "source_queries",
)


def load_all():
    from barloom.plans.registry import QUERIES

    for m in MODULES:
        importlib.import_module(f"barloom.plans.{m}")
    return QUERIES
