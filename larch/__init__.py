"""larch: catalogue matching, requirement planning and corpus operators on PySpark DataFrames."""

from pyspark import cloudpickle

# Functions that run on executors travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(__import__(__name__))
