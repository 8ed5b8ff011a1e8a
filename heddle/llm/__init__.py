"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage.  The functions that run on
executors are shipped by value, so executors need Python and Spark, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
