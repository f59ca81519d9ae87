"""gridsquall: Spark-native analytics for ramps and extremes in dense sensor networks.

Worker functions are pickled by value, so executors need Spark, NumPy, pandas and
pyarrow, but not this package on their path.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
