"""Spark-native entity knowledge engine: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job: no --py-files, no PYTHONPATH on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
