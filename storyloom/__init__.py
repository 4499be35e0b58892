"""Event-graph analytics on Spark."""

import os
import sys
from pathlib import Path


def _ship_code() -> None:
    """Where Python workers cannot import this package from their path, its functions travel with the tasks."""
    root = str(Path(__file__).resolve().parent.parent)
    if root not in [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_code()
