import pytest

from vestigia.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(partitions=4, memory="6g")
    yield session
    session.stop()
