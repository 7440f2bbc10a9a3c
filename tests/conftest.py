import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from slotbook.session import local_session
    s = local_session(cpus="*", shuffle_partitions=8, app="slotbook-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def cat(spark):
    from slotbook.sources.views import Catalog
    return Catalog(spark, SMOKE_DIR)
