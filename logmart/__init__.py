"""logmart: header/child/bridge analytics over activity logs on Spark.

Operators are DataFrame -> DataFrame functions (``logmart.operators``),
column expressions (``logmart.functions``), readers and writers
(``logmart.sources``), streaming jobs (``logmart.streaming``) and the
wiring to the driver's test tables (``logmart.plans``).

The few operators that run Python on executors (the lockout fold and the
per-header change fold) must work without the package being installed on
the workers, so the package's functions are pickled by value.
"""

from __future__ import annotations

import sys

try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: install the package on executors instead
    pass
