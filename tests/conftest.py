import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from terracell.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, shuffle_partitions=4, memory="8g")


@pytest.fixture(scope="session")
def fx(spark):
    from checks.fixture import Fixture

    return Fixture(spark, SMALL)
