"""promptwatch: security analytics for prompt traffic, written as PySpark DataFrame programs."""

import sys

from pyspark import cloudpickle

from promptwatch.params import Params

# Executors need not have the package installed: functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Params"]
