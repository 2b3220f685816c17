import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from assaylake.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4, app="assaylake-tests")
    yield s
    s.stop()


@pytest.fixture
def many_parts(spark):
    """Small tables stay in as many shuffle parts as the session has."""
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    yield
    spark.conf.set(conf, "true")
