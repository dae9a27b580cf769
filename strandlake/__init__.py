"""Sparse voxel fields and curve networks as Spark DataFrames."""

import sys

from pyspark import cloudpickle

from strandlake.params import Params
from strandlake.session import get_spark, materialize

# Grouped functions travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Params", "get_spark", "materialize"]
