"""Spark jobs for hierarchical 3-D tile sets, and for preparing text corpora (subpackage llm)."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
