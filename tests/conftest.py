import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL_SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from vouch.session import build_session

    s = build_session(cores="*", shuffle_partitions=8, app="vouch-tests")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
