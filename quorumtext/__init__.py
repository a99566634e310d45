"""Consensus text analytics on Spark."""

import sys

from pyspark import cloudpickle

# functions travel to Python workers with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
