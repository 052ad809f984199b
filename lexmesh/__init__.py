"""Text analytics over small word lists and large corpora, on Spark DataFrames.

Functions that run inside Python workers are pickled by value, with the
package, so executors need neither this folder on their path nor an
installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
