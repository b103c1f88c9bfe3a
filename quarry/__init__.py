"""Quarry: a Spark-first engine for public-record documents and the leads they hold."""

__version__ = "0.1.0"
