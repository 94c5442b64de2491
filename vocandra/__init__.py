"""vocandra: a Spark-first engine that ranks job postings against candidate profiles."""

__version__ = "0.1.0"
