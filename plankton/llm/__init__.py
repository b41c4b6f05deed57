"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage.  Its helper functions
travel to the executors by value, so a cluster needs no copy of the code.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
