import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from checks.compare import local_session
    from milaan.session import tuned

    session = tuned(local_session("8"))
    yield session
    session.stop()
