"""Operators for preparing training data, each a Spark job over whole tables.

Nothing else in the library imports this package. Its Python functions are sent
to the executors by value, so workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
