"""All registered queries of the engine and their DuckDB equivalents."""

from __future__ import annotations

from isobar.plans import catalogue, modelling, reviewing, scenarios  # noqa: F401  importing a module registers its queries
from isobar.streaming import replay

QUERIES = dict(catalogue.QUERIES) | dict(replay.QUERIES)
ORACLES = dict(catalogue.ORACLES) | dict(replay.ORACLES)
