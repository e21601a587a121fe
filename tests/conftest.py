import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from proseweave.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "tests", "8g")
    ship_package(s)
    yield s
    s.stop()
