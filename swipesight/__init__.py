"""Card-transaction and fraud analytics as lazy Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few Python helpers that run in tasks travel with the job; workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
