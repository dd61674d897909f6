"""storelens: retail performance analytics on Spark.

Every operator is a DataFrame -> DataFrame function built from Spark SQL
expressions, window functions, aggregations and ``pyspark.ml``; there are no
Python UDFs in any data path.
"""

from storelens.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
