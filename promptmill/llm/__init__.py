"""Operators of a training-data pipeline over documents and vectors."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks ship with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
