"""gatelight: verification-gated speech analytics and corpus preparation on PySpark.

Functions that run in Python workers are shipped by value, so executors need pyspark, numpy and
pyarrow but no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
