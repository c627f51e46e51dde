"""Operators for training data: mixing, quality, chat pairs, duplicates, language, packing, secrets."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so they run wherever the package is not installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
