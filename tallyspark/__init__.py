"""Spark-first analytics for multi-sample reasoning runs and training corpora."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: no --py-files, no install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
