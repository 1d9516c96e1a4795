"""A PySpark-native engine for PII detection and pseudonymisation."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value: the workers need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
