"""webloom: crawl pages, job tables and event logs as Spark tables.

Every operator is a function ``DataFrame -> DataFrame`` (or ``Column -> Column``) built from
Spark's own operators; nothing runs until the caller writes or collects the result.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
