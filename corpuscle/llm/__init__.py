"""Operators for preparing text to train language models on.

Nothing else in the library imports this package. `queries` holds the registered queries and their SQL.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
