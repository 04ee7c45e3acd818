"""chronoweave: temporal text-graph analytics and corpus preparation as Spark DataFrame programs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
