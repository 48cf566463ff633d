"""pagegrain: stored web pages to clean, typed tables, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Arrow functions travel to the executors with their code, so a cluster needs
# no copy of this package on its Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
