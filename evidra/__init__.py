"""Spark-native forensic timeline and detection analytics."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so that executors needn't have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
