"""Queries over the driver tables, each with the SQL that states the same result."""

from __future__ import annotations

from loomfield.plans.registering import ORACLES, QUERIES


def _load() -> None:
    from loomfield.plans import arrays, evidence, integrity, panels, retrieval, rules, series, sources, streams  # noqa: F401


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
