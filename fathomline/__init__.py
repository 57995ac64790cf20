"""Fathomline: a PySpark-native engine for record-oriented text and evaluation data."""

import sys

from pyspark import cloudpickle

# Kernels that run in Python workers travel inside the task, so that executors
# need no copy of this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
