"""Dataset curation on Spark: unify, profile, check, clean, annotate, select.

Every operator takes a DataFrame and returns a DataFrame. Nothing is collected
to the driver on the data path, and no operator keeps a session of its own.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with the task, so that a session
# started elsewhere needs no copy of this package on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
