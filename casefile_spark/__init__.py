"""Spark-native analytics over large document casefiles."""

import sys

from pyspark import cloudpickle

# Batch functions travel to the executors by value, so the package needs no install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
