import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scorelab.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "scorelab-tests", "8g")
    yield session
    session.stop()


@pytest.fixture
def many_partitions(spark):
    """Force many small range and hash partitions, so chunk borders really occur."""
    names = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in old.items():
        spark.conf.set(n, v)


@pytest.fixture(scope="session")
def fixture_scores(spark):
    rows = [
        (1, 0, 0.1, 0.2, "1"), (2, 0, 0.4, 0.3, "1"), (3, 1, 0.4, 0.35, "1"), (4, 1, 0.8, 0.6, "1"),
        (5, 0, 0.2, 0.5, "2"), (6, 1, 0.9, 0.55, "2"), (7, 0, 0.7, 0.45, "2"), (8, 0, 0.3, 0.1, "2"),
    ]
    wide = spark.createDataFrame(rows, "row_id long, y int, a double, b double, g string")
    return wide.unpivot(["row_id", "y", "g"], ["a", "b"], "model", "p")
