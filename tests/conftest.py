import pytest

from dimlens.session import local_session

from tests import company


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session(4, partitions=4, memory="4g", checkpoint_dir=shared)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def firms(spark):
    return company.dataset(spark)
