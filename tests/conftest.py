import pytest

from voltlane.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(name="tests")
