"""newsweave: PySpark-native news-digest analytics."""

import sys

try:  # ship the package's functions with the tasks (pandas UDFs, mapInPandas)
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: rely on --py-files
    pass
