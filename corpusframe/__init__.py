"""corpusframe: Spark jobs over document corpora and the questions asked of them.

Every job takes DataFrames and returns a DataFrame. Python helpers that run inside tasks travel with the job
(pickled by value), so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
