"""The registered queries of this subpackage."""

from fleetlens.llm import (  # noqa: F401
    contamination,
    dart_minhash,
    importance,
    language,
    line_runs,
    mixing,
    periodic_runs,
    phrases,
    quality,
    secrets,
    token_files,
    toxicity,
    wrappers,
)
from fleetlens.llm.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
