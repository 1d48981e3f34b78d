"""Reference reconciliation and corpus preparation on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job: a cluster needs no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
