import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pagequern.session import local_session, ship_package

    session = local_session("4", **{"spark.sql.shuffle.partitions": "4"})
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def base():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA
