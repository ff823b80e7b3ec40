"""Operators for preparing language-model training data; nothing else in the library imports them."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The functions travel to the Python workers with the job, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
