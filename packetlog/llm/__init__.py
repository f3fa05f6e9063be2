"""Training-data pipeline operators: search, counting, scoring and deduplication
of text tables. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to executors by value, so that executors
# need numpy and pyarrow but not this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
