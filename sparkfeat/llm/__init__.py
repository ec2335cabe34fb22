"""Operators for preparing text corpora. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Python workers get the functions of this package with each job, so that executors need no copy
# of it on their path. Large closures (vocabularies, weights) are broadcast by Spark.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
