"""One local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from frameloom.jobs.session import importable, local_session

    session = local_session("tests", cpus=os.environ.get("TEST_CPUS", "4"), shuffle=4)
    session.sparkContext.setLogLevel("ERROR")
    yield importable(session)
    session.stop()
