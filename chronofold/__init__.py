"""Frame stacking and keyed time-axis reductions on PySpark DataFrames.

The package's functions travel to the executors by value, so a worker that cannot import it can still run them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
