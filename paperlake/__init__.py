"""paperlake: a PySpark-native engine for literature retrieval and analysis.

Operators take DataFrames and return DataFrames. The package is pickled by
value, so executors need no copy of it on their Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
