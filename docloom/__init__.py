"""docloom: document analytics and retrieval as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so the
# executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
