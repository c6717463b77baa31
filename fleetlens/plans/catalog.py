"""Imports every query module so that the registry is complete."""

from fleetlens.plans import queries_chain, queries_feeds, queries_functions, queries_gold, queries_mart, queries_models, queries_network, queries_reports, queries_sampling, queries_silver, queries_storage  # noqa: F401
from fleetlens.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
