"""Document-corpus analytics as Spark jobs: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

from corpuscle.config import Settings

__all__ = ["Settings"]

# Functions that run in tasks travel with the job: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
