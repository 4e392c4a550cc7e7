"""loyalscope: Net Promoter Score analytics over review tables, as Spark DataFrame plans.

Layout
------
``sources``    readers with explicit schemas, the oracle fixture views, the sentiment-file adapter
``functions``  column expressions: tiers, age buckets, month keys, exact rounded measures
``operators``  DataFrame -> DataFrame building blocks: tagging join, base cells, rollups,
               monthly windows, peer benchmarks, driver ranking, text lift, recovery, input checks
``plans``      the complete queries and the registry used by ``__spark_entry__``
"""

import sys

from pyspark import cloudpickle

from loyalscope.session import get_session

# Functions that run in Python workers travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session"]
