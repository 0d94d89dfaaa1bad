import pytest

from tesserae.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
