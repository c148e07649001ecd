"""siglume: a Spark-native analytics engine for ordered numeric signals."""

from pyspark import cloudpickle as _cloudpickle

# Kernels travel to the executors by value, so no executor needs the package installed.
import sys as _sys

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
