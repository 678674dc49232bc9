import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark():
    from flowmill.session import local_session

    s = local_session(8, shuffle_partitions=4)
    yield s
    s.stop()
