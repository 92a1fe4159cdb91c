"""Passage retrieval and text analytics as Spark dataflows."""

import sys

from pyspark import cloudpickle

# Functions for the executors travel with their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
