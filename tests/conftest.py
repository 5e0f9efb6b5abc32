import pytest

from paneloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("8", 8, "6g", "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
