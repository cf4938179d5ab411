"""Operators for preparing training text at scale, and their queries."""

import sys

from pyspark import cloudpickle

# Executors get the functions themselves and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
