"""All registered queries with the SQL that gives the same rows."""

from __future__ import annotations

from millrace.plans import admission, asking, changes, dependencies, diffs, evaluation, expansion, experiments, exploration, files, graphs, health, hotspots, inspection, lifecycle, lineage, ordered, overlays, packing, predicates, reports, requests, resolution, retrieval, rollups, scoring, states, streams, taskviews  # noqa: F401
from millrace.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
