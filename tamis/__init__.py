"""Spark-native record intelligence: expressions, gates, deduplication, selection and reports."""

import sys

from pyspark import cloudpickle

# What runs on executors goes there with the job, so that they needn't have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
