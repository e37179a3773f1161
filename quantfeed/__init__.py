"""Market data and market news jobs on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
