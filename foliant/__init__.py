"""Document analytics as DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run on executors are sent by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
