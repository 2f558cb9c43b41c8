import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark():
    from logloom.session import local_session, workers_can_import

    session = local_session(cores="4", shuffle_partitions=4, app="logloom-tests")
    workers_can_import(session)
    yield session
    session.stop()
