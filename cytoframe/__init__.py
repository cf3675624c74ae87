"""Spark-native analytics for imaging assays: inventories, label rasters, tracks, motility."""

import sys

from pyspark import cloudpickle

# Grouped-map kernels travel to executors by value, so a cluster needs no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
