"""Registered queries."""

from __future__ import annotations


def load_queries() -> dict:
    from terrapanel.plans import cleaning_queries, file_queries, model_queries, panel_queries, source_queries, spatial_queries  # noqa: F401
    from terrapanel.plans.catalog import REGISTRY

    return REGISTRY
