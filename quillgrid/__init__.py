"""Business-table analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Worker-side helpers travel with the task, so a cluster needs no extra install step.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
