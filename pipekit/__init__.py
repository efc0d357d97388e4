"""Data-preparation operators as plain functions from DataFrame to DataFrame.

Functions that run in tasks travel to the executors by value, so that executors need not have this
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
