"""Operators of a training-data pipeline and their named queries."""

import sys

from pyspark import cloudpickle

# Functions of these modules travel to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
