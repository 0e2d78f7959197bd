"""Operators of a training-data pipeline: rules, deduplication, decontamination, mixing, shards.

Nothing else in the library imports this package. Functions that run inside tasks are shipped
by value, so executors need numpy, pandas and pyarrow but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
