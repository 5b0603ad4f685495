import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("TARNWELL_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from tarnwell.runtime import session, ship

    s = session(4, "tests")
    s.sparkContext.setLogLevel("OFF")
    ship(s)
    yield s
    s.stop()
