"""Spark-native time-series analytics: cleaning, features, detection, forecasting, explanation.

Functions that run inside Python workers are pickled by value, so executors need Spark's own
dependencies only and no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
