"""Vellum: document-layout analytics and corpus processing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

#: Functions that run in Python workers travel with the plan: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
