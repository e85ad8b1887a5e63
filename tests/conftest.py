import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from quillspark.session import build, ready

    s = build("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield ready(s)
    s.stop()
