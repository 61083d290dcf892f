"""Operators for the preparation of training data. Nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions go to executors whole, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
