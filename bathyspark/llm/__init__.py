"""Operators for training-data pipelines.

Nothing else in the package imports this one.  Its functions are shipped to
Python workers by value, so executors need the libraries that an operator
names, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
