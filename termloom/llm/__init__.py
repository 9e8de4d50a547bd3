"""Operators that prepare training text: packing, filters, duplicates, archives.

Functions of this package that run in Python tasks travel to the executors by
value, so a cluster needs the package on the driver only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
