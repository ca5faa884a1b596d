import os
import sys

import pytest

_HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(_HERE))
# Python workers import the package and classes of the tests.
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (os.path.dirname(_HERE), _HERE, os.environ.get("PYTHONPATH")) if x)


@pytest.fixture(scope="session")
def spark():
    from voxmill.session import build_session

    s = build_session("local[4]", 4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
