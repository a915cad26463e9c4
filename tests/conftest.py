import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from combline.session import local_session, release  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, memory="4g", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    release(s)
    s.stop()
