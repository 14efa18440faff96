"""All registered queries and oracles."""

from __future__ import annotations

from loomtrail.plans import business, exploration, graph, ingestion, scalars  # noqa: F401
from loomtrail.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
