import pytest

from siltstone.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=8, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    return session
