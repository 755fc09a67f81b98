import pytest

from dsforge.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(cores=4, memory="6g", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
