"""Preparation and analysis of multi-arm cluster-randomised trials on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run in Python workers travel with the job, so the workers need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
