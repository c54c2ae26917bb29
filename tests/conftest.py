import pytest

from quern.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g", 4)
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    yield session
    session.stop()
