"""Domain-risk analytics on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames; row logic is written
as Column expressions so Catalyst sees the whole plan.
"""

import sys

from pyspark import cloudpickle

# Functions used inside tasks travel with the job, so executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
