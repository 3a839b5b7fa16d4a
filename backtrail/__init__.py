"""backtrail: event, track and attribution analytics as plain Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: its few Python functions travel with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
