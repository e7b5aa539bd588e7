"""graphloom: network statistics and inference under incomplete data, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Workers need not have this package on their path: its functions travel inside the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
