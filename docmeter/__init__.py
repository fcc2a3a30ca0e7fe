"""Document-retrieval analytics on Spark: chunking, retrieval, evaluation and accounting as DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors with the job, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
