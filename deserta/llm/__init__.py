"""Operators for preparing training text: one module per operator, queries in ``queries.py``."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so these need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
