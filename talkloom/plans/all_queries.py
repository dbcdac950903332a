"""Imports every query module, so that the registry is full."""

from talkloom.plans import q_catalog, q_render, q_sources, q_streaming, q_tags, q_text, q_timeline, q_written  # noqa: F401
from talkloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
