"""Operators for preparing training text. Nothing else in the package imports this folder.

Functions that run in Python workers travel by value, so executors need the
libraries (numpy, pyarrow, tokenizers, xxhash) but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
