import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from askgrid.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", os.environ.get("TEST_MASTER", "local[8]"), "8g", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
