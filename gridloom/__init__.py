"""A PySpark-native engine for gridded and sparse-point data: one row per cell, layers as columns.

Its functions travel to the executors by value, so workers need no installed copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
