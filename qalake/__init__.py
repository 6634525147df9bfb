"""qalake: Spark-native retrieval and answer-extraction analytics."""

import sys as _sys

try:
    # Functions of this package that run inside Python workers (pandas UDFs,
    # cogroup / mapInPandas bodies) are shipped by value, so executors need
    # no installed copy of the package.
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to imports
    pass
