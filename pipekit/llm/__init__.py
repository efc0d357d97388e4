"""Operators for large text corpora; nothing else in the library imports this subpackage.

Functions of this subpackage travel to the executors by value, so that executors need the
installed dependencies but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
