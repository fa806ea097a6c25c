import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL_SF = "/root/testdata/sf0.001"
CHECK_SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from catwarden.session import local_session
    s = local_session("4", app="catwarden-tests")
    s.conf.set("spark.sql.shuffle.partitions", "8")
    yield s
    s.stop()
