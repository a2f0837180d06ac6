import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowlens.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=2, memory="6g")
    # fixtures hold a few rows: compiling stages would take most of the time (compare.py and bench.py do compile them)
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    return session


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("driver tables are not here")
    return SF
