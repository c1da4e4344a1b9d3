"""Queries over the canonical views, grouped by operator family."""

from importlib import import_module

FAMILIES = (
    "balance_queries",
    "temporal_queries",
    "skill_queries",
    "zonal_queries",
    "network_queries",
    "grid_queries",
    "join_queries",
    "column_queries",
    "demand_queries",
    "run_queries",
    "source_queries",
    "stream_queries",
)


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"hydroloom.plans.{family}")
