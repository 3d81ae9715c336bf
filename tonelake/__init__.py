"""Speech-annotation analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so workers need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
