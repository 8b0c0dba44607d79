"""One session for all tests."""

import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from quillon.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", 4, spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
