"""Operators for training-data pipelines. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions of this package run inside Python tasks; executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
