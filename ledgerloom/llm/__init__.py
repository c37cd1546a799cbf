"""Operators for preparing training text at large scale.

Each ``opN_*`` module holds one operator with a general interface and the thin
query that applies it to the given tables. Nothing else in the library imports
this subpackage.

Functions of this subpackage that run inside Python workers are sent by value,
so executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
