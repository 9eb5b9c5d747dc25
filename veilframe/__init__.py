"""Document sanitization and corpus processing on PySpark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel whole: executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
