"""A PySpark text-applicability engine; functions that run on executors travel by value, so executors need not have this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
