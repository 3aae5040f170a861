"""clinmill: a Spark-native engine for curating clinical text and labelled cases.

Operators are ``DataFrame -> DataFrame`` functions.  The package is pickled by
value, so its Python kernels run on executors that do not have it installed.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
