"""escarp: terrain and climbing-site analytics as Spark DataFrame programs."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
