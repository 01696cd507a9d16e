"""Cross-bank risk signals as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run in Python tasks travel with the job, so the workers of a cluster need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
