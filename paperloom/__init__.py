"""Document and table analytics as composable DataFrame -> DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value, so nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
