import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from fernglass.runtime import session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", 8)
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


@pytest.fixture
def rows():
    """The rows of a frame as a sorted list of tuples."""

    def run(df, *cols):
        d = df.select(*cols) if cols else df
        return sorted((tuple(r) for r in d.collect()), key=repr)

    return run
