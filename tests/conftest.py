import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from dosewise.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[8]", 4)
    s.sparkContext.setLogLevel("OFF")
    yield s
