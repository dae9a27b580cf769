import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strandlake import get_spark


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", master="local[4]", shuffle_partitions=4, driver_memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def vox(spark):
    """Voxel table from a list of (z, y, x, *extra)."""
    from strandlake.grid import with_vid

    def make(rows, extra=""):
        schema = "z int, y int, x int" + (", " + extra if extra else "")
        return with_vid(spark.createDataFrame([tuple(map(_py, r)) for r in rows], schema))
    return make


def _py(v):
    return v.item() if hasattr(v, "item") else v
