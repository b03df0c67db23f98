import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="tillpoint-test-")
    os.environ.setdefault("TILLPOINT_SCRATCH", scratch)
    from tillpoint.session import build_session, ensure_checkpoint_dir
    s = build_session("local[4]", app="tillpoint-tests", shuffle_partitions=8,
                      extra={"spark.local.dir": scratch})
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from tillpoint.sources.tables import Tables
    return Tables(spark, SMALL)
