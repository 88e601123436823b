"""Curve-network analytics on Spark tables: pixels, points, graphs, traces and step logs."""

import sys

from pyspark import cloudpickle

# functions that run inside tasks travel with the job, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
