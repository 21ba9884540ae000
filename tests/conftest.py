import pytest

from keyweave.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(shared=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
