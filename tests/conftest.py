import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from furrow.lineage import forget  # noqa: E402
from furrow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, memory="4g", name="furrow-tests")
    yield session
    forget(session)
    session.stop()
