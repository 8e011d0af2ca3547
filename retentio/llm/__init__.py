"""Operators of a training-data pipeline over ``documents``-like tables."""

import sys

from pyspark import cloudpickle

# task functions travel by value: executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
