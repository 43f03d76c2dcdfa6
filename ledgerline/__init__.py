"""ledgerline: transaction analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that a cluster whose
# executors lack the package on their path still runs the Python operators.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
