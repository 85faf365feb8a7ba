"""Intervals, signals, gene models and tables of features on Spark."""

import sys

from pyspark import cloudpickle

# Executors get the code of these modules with the plan, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
