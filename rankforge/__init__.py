"""rankforge: retrieval evaluation and judge-vote analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions used in pandas UDFs travel with the task, so workers need no copy
# of this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
