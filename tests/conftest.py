import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from prepline.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="prepline-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small(spark):
    """FIXTURES section 6: the hand-worked profile table."""
    import datetime as dt

    rows = [
        (1, 1.0, "a", "2024-01-05", True),
        (2, 2.0, "a", "2024-02-29", True),
        (3, 3.0, "b", None, False),
        (4, 10.0, None, "2024-03-01", False),
        (5, None, "a", "2024-12-31", True),
        (5, None, "a", "2024-12-31", True),
    ]
    del dt
    return spark.createDataFrame(rows, "id long, x double, c string, d string, b boolean")
