"""Queries over the test tables, by operator name."""

from chronoplane.plans.registry import REGISTRY, Tables, presented


def load() -> dict:
    """All registered queries."""
    import importlib

    for module in MODULES:
        importlib.import_module(f"chronoplane.plans.{module}")
    return REGISTRY


MODULES = (
    "history_queries",
    "column_queries",
    "relational_queries",
    "dataset_queries",
    "evaluation_queries",
    "source_queries",
    "model_queries",
)

__all__ = ["REGISTRY", "Tables", "load", "presented"]
