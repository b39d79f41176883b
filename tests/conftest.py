import pytest

from tracklattice.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"
