import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tarmac.session import get_session
    s = get_session("local[4]", app="tarmac-tests", shuffle_partitions=4,
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tarmac-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_dir():
    return SMALL
