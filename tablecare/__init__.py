"""Profile, check, clean, feature, drift, evaluation and streaming operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors get the few Python functions by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from tablecare.session import get_spark, small_rows  # noqa: E402
from tablecare.tables import load, views  # noqa: E402

__all__ = ["get_spark", "small_rows", "load", "views"]
