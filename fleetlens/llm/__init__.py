"""Operators of a training-data pipeline over text: the dealt list, built on Spark DataFrames.

Functions that run inside Python workers are sent to them by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
