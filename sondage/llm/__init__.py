"""Operators for large-scale training data: cleaning, search, mixing, tokenising and packing of text.

Every operator is a function from DataFrames to DataFrames with its own
module; ``queries`` applies them to the given tables.  The package travels to
the executors by value, so it need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
