"""Web-access-log ingestion and hourly request analytics on PySpark.

Packages, from the inside out:

``functions``  Column -> Column building blocks (timestamps, JSON, CSV, keys)
``sources``    request bodies, hourly log files, listings, topics
``operators``  DataFrame -> DataFrame steps (ingest, counting, freshness, ...)
``sinks``      hourly logs, summaries, dead letters, topics
``plans``      batch jobs that join the above into one run
``streaming``  the same work on Structured Streaming sources
"""

import sys

from pyspark import cloudpickle

from hourtally.session import build_session, configure

# Functions that run in tasks travel with them, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "configure"]
