"""Operators for training-data pipelines over a table of documents.

Nothing else in the library imports this package. Its functions travel to the
workers by value, so the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
