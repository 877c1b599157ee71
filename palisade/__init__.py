"""Web-security event analytics as PySpark DataFrame operators.

Everything takes and returns DataFrames: read events, validate them, enrich them with an
attack type, a threat score and a repeat-offender flag, keep one row per event id, and
summarise, chart, sample or audit the result.
"""
import sys

from pyspark import cloudpickle

from palisade.policy import Policy

# The few functions that run in Python workers travel with the plan, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Policy"]
