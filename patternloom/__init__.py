"""Log-pattern analytics on Spark: templates, typed variables, statistics, anomalies, reports."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors travel whole, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
