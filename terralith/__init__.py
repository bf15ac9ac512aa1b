"""terralith: a Spark-first analytics engine for gridded and point-based environmental data."""

import sys

from pyspark import cloudpickle

# Functions go to executors by value, so that these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
