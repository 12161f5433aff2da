"""Token-reuse text analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so that no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
