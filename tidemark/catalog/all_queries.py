"""Imports every query module so the registry is complete."""

from tidemark.catalog import q_aggregates, q_filings, q_joins, q_merge, q_quality, q_scalars, q_series, q_sources, q_states, q_streaming  # noqa: F401
from tidemark.catalog.registry import COVERS, ORACLES, QUERIES  # noqa: F401
