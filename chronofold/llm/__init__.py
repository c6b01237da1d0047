"""Training-data operators: one module each, queries and SQL in ``registry``.

Nothing else in the library imports this subpackage. Its functions travel to the executors by value, so a worker
that cannot import the package can still run them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
