"""Operators for large text corpora: deduplication, scoring, packing.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the task, so executors do not
# need this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
