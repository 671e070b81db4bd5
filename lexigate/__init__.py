"""Keyword matching and content categorisation as Spark DataFrame plans."""

import sys as _sys

__version__ = "0.1.0"

# Functions run on executors (mapInPandas, the UDTF, keyed stream state) are
# shipped with their code, so executors need no install of this package.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: install the package instead
    pass
