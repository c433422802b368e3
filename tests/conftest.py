import os

import pytest

from quillspan.session import build_session

SMALL = os.environ.get("QUILLSPAN_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", cpus=4, memory="4g", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL
