"""Operators for preparing training text.  Each module holds one operator and its query.

Functions that run inside tasks are sent to the executors by value, so that these need the
libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
