import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tallyframe.session import local_session, ship_package

    os.environ.setdefault("TALLYFRAME_DRIVER_MEMORY", "4g")
    s = local_session("tests", "4")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    ship_package(s)
    return s
