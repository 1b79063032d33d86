"""Point-in-time feature engine and time-series data processing on PySpark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions sent to executors travel by value: the cluster's Python needn't have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
