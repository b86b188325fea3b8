"""tidewell: a document catalogue, retrieval and evidence engine written as PySpark plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run in Python workers travel with the job: executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
