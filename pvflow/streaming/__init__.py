"""Structured Streaming forms of the batch operators."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Stateful processors travel to the Python workers with the job, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
