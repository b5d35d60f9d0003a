"""runloom: process analytics over step-by-step run logs, as Spark DataFrames."""

import sys

from pyspark import cloudpickle

from runloom.session import get_session

# Ship the small Python helpers with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session"]
