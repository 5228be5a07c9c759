"""cipherlake: a Spark-native engine for encrypted-flow analytics.

Everything is a function from DataFrames to DataFrames.  Functions that run in
Python workers are pickled by value, so a job needs no ``--py-files``.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
