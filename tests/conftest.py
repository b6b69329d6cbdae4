import pytest

from factloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    yield local_session(4)
