"""twinscan: find copied and closely related work in large submission collections, on Spark."""

import sys

from pyspark import cloudpickle

# Send the few Python helpers to the workers by value; executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
