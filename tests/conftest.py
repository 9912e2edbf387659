import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from corvina.session import local_session

    s = local_session(4, 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("test tables are not here")
    return DATA
