import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from panelforge.session import get_spark, checkpoint_dir
    s = get_spark("local[4]", "panelforge-tests", shuffle_partitions=4)
    checkpoint_dir(s)
    yield s
