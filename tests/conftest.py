from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from gradelake.session import build_session

    session = build_session("local[8]", partitions=8, app="tests", **{"spark.driver.memory": "8g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from gradelake.plans.fixtures import Tables

    return Tables(spark, FOLDER)
