"""Operators of a training-data pipeline. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
