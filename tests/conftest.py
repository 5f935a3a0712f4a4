import pytest

from tests.oracle_check import session


@pytest.fixture(scope="session")
def spark():
    s = session("4")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
