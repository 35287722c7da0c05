"""Operators for preparing language-model training data. Nothing outside imports this package."""
import sys

from pyspark import cloudpickle

# Functions of this package travel with the tasks; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
