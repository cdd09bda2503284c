"""A PySpark-native engine for temporal semantic networks."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code, so the workers need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
