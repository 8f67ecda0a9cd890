"""hindcast: leak-free point-in-time features and backtests on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers with their code, so that workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
