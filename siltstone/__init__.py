"""Siltstone: a Spark-native dataset curation engine.

Everything is ``DataFrame -> DataFrame``; functions that need Python on the
executors travel by value, so that workers need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
