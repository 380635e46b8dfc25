"""Spark-native analytics for categorical state sequences and event sequences."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors travel whole, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
