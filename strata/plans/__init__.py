"""Named queries over the given tables, with plain SQL that computes the same."""

from __future__ import annotations

from strata.plans.registry import ORACLES, QUERIES


def load_all() -> None:
    """Import every module that registers queries."""
    from strata.plans import analytics, domains, functions, quality, records, sources, streams, transforms, warehouse  # noqa: F401


__all__ = ["ORACLES", "QUERIES", "load_all"]
