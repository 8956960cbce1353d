from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[2])]

from fleetlens.llm.common import prepare  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """docs([text, ...]) or docs([(id, text), ...]) as documents; ``extra`` adds columns of clashing names."""
    prepare(spark)

    def build(rows, extra: dict[str, str] | None = None):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, "en", "s", None, *(extra or {}).values()) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA + "".join(f", {c} string" for c in extra or {}))

    return build
