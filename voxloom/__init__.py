"""Review analytics on Spark: ingest, scrub, cluster, report and audit app reviews."""

import sys

from pyspark import cloudpickle

# Arrow functions of this package run in Python workers that need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
