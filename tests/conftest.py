import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from stillwave.session import local_session

    return local_session(4, shuffle_partitions=4, app="tests")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
