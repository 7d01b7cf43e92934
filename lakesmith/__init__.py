"""lakesmith — a PySpark library for table refinement and batch retrieval."""

import sys as _sys

try:  # ship this package's code inside task closures (no install needed on executors)
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark without by-value registration
    pass
