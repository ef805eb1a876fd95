"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from stayweave.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, partitions=4)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("steps")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
