"""weftline: Spark-first analytics for text and parallel corpora.

Every operator is a function from DataFrames to a DataFrame (or an expression
that returns a Column), so Catalyst sees one declarative plan.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need
# no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
