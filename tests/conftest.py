import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sigclass.session import get_session
    s = get_session(master="local[8]", app="sigclass-tests", shuffle_partitions=8,
                    extra={"spark.driver.memory": "8g"})
    yield s
    s.stop()


@pytest.fixture(scope="module", autouse=True)
def no_cached_tables_are_left():
    """Tables that a module's tests cached are dropped after it: a later test looks at all that is cached."""
    from pyspark.sql import SparkSession
    yield
    if s := SparkSession.getActiveSession():
        s.catalog.clearCache()
