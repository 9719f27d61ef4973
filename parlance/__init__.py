"""Conversation-corpus analytics on Spark."""

import sys

from pyspark import cloudpickle

# tasks get the package's functions by value, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
