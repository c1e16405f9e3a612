"""Spark-native analytics over officials' financial disclosures.

The package's Python functions are sent to the executors by value, so workers
need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
