"""shelfrate: retail catalogue pricing, promotions and vendor-feed ingest on Spark.

Every operator is a function from DataFrames (plus an explicit ``as_of``
instant where time matters) to DataFrames, built from Catalyst expressions.
"""

__version__ = "0.1.0"
