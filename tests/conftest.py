import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quire.session import local_session

    session = local_session(app="quire-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
