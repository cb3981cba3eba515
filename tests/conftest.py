import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pairnet.session import local_session

    s = local_session(cores=4, shuffle_partitions=4, app="pairnet-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    from oracle_check import duck

    return duck(SF_SMALL)
