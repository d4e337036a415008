"""textloom: Spark-native text-labelling analytics (see README.md)."""

import sys as _sys

try:  # ship the package's UDF code inside each task, so workers need no install
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark without by-value registration
    pass
