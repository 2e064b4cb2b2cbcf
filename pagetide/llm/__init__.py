"""Operators for training data: scans, classifiers, deduplication, tokens."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors by value: these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
