"""Gristmill: DataFrame operators for Spark, expressed as lazy plans.

Functions that must run in Python workers are pickled by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
