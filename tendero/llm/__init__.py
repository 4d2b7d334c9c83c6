"""Operators for the preparation of training text.

Each module holds one operator with its own interface; ``queries`` applies them to whole
tables. Nothing outside this folder imports from it.
"""

import sys

from pyspark import cloudpickle

# What runs inside tasks travels with them, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
