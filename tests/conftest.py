from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from fleetlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "fleetlens-tests")


@pytest.fixture(scope="session")
def files(spark):
    """files(repo=[(path, content), ...], ...) as a files table."""

    def build(**repos):
        rows = [(repo, 1, path, content) for repo, entries in repos.items() for path, content in entries]
        return spark.createDataFrame(rows, "repo string, push_id bigint, path string, content string")

    return build
