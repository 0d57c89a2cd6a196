"""Sensor-health analytics on Spark: windows, scores, limits, alerts, truth, metrics and data preparation."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
