"""Training-data operators: tokenising, de-duplication, quality, privacy, licences and mixing."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry their own code: the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
