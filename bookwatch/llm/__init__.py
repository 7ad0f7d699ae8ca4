"""Operators for large training-data pipelines; nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that a cluster
# needs no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
