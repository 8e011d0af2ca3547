import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from retentio.session import build_session, clean_scratch
    s = build_session("local[4]", shuffle_partitions=8, app_name="retentio-tests")
    yield s
    clean_scratch(s)
    s.stop()
