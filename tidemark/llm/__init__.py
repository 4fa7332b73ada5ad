"""Operators of a training-data pipeline over documents, pages, benchmarks and conversations."""

import sys

from pyspark import cloudpickle

# Executors get the functions by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
