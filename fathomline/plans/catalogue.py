"""All queries of the engine."""

from __future__ import annotations

from fathomline.plans import answers, cases, kernels, records, relational, runs, spans, statistics, storage  # noqa: F401
from fathomline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
