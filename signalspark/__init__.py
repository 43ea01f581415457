"""signalspark — Spark-native multi-tenant observability analytics.

Every operator is a plain ``DataFrame -> DataFrame`` function built on Spark
SQL expressions, so the same body serves batch jobs and Structured Streaming.
"""

__version__ = "0.1.0"
