"""Evidence retrieval and analytics on Spark.

Functions that run in Python workers are pickled by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
