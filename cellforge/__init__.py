"""Grid land-allocation analytics and corpus operators on Spark."""

import sys

from pyspark import cloudpickle

# Functions for tasks travel with their code: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
