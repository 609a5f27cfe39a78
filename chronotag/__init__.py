"""Tagged events and timeseries as plain Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code with them, so workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from chronotag.model import MAX_TIME, Store, session  # noqa: E402

__all__ = ["MAX_TIME", "Store", "session"]
