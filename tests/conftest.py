import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sijill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("sijill-tests", 8)
    yield session
    session.stop()


@pytest.fixture
def out_dir():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")
