import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from panelkit.session import build_session
    s = build_session("local[*]", app="panelkit-tests", shuffle_partitions=8)
    yield s
