"""Tree synchronisation and transfer analytics as Spark jobs.

The package is pickled by value, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
