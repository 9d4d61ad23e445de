"""Corpus preparation operators. Nothing outside this folder imports it.

Functions of this package travel to the Python workers by value, so executors
need numpy, pandas and the tokenizer libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
