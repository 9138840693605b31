import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from quarry.session import local_session

    session = local_session("*", shuffle_partitions=8, driver_memory="4g")
    yield session
    session.stop()


@pytest.fixture
def tmp_out(tmp_path):
    return str(tmp_path)
