"""Operators for training-data pipelines: each module holds one operator and its registered query.

Functions of this subpackage travel to executors by value, so executors need
pyspark, numpy and pyarrow but no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
