import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from claims_cohorts.session import local_session

    session = local_session("*", shuffle_partitions=8, app="claims_cohorts_tests")
    yield session
    session.stop()


@pytest.fixture
def d():
    import datetime as dt

    def make(text):
        return None if text is None else dt.date.fromisoformat(text)

    return make
