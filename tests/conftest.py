import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from sluice.session import get_spark

    s = get_spark("local[4]", 4, spark__driver__memory="4g", spark__checkpoint__dir=tempfile.mkdtemp(prefix="sluice-ckpt-"),
                  spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="sluice-wh-"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
