"""Operators that prepare text for training language models."""

import hourtally
from pyspark import cloudpickle

# Functions that run in tasks travel with them, so executors need no copy of the package.
# What is broadcast carries its classes along by ``common.Shared``.
cloudpickle.register_pickle_by_value(hourtally)
