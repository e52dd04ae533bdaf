"""Speech-marker and speaker-level analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so that executors need no copy
# of this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
