"""strandline: DataFrame operators for object tracking, time-lapse tables and training-text pipelines."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors with the job, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
