"""provenant: dated document corpora and retrieval analytics as PySpark DataFrames."""

import sys

from pyspark import cloudpickle

from provenant.settings import Settings

# Functions that run in tasks travel with the job; executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Settings"]
