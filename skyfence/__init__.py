"""Wireless telemetry analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from skyfence.session import get_session

# Ship the package's helpers with the tasks, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session"]
