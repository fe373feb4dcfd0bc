"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("intensity_queries", "cohort_queries", "space_queries", "volume_queries", "stream_queries", "more_queries", "frame_queries", "oracle_queries")


def _families() -> list:
    return [import_module(f"osteon.plans.{f}") for f in FAMILIES]


def queries() -> dict:
    return {name: q for family in _families() for name, q in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in _families() for name, sql in family.SQL.items()}
