"""talkloom: talk and podcast transcript analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package that run in tasks travel by value, so that executors need not have the
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
