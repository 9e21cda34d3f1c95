"""Combat-event analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with their code: executors need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
