"""Seed-based sequence mapping and similarity search on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions go to the workers with their code, so that a cluster need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
