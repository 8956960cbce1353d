"""All registered queries."""

from fleetlens.plans import extraction, fleet_reports, history, judgement, policy, sources, streams  # noqa: F401
from fleetlens.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
