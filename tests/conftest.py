import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from corpusgraph.session import session

    s = session("tests", "local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="4", spark__driver__memory="6g", spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-"), spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
