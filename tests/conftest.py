import pytest

from millrace.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("millrace-tests", cores=4, partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
