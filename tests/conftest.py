"""One local session for all tests; workers find the package through PYTHONPATH."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
os.environ.setdefault("TIDEMARK_DRIVER_MEMORY", "3g")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    session = local_session(4, "tests", 4)
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    yield session
    session.stop()
