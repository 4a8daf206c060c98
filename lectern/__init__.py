"""Scripture-reference analytics on Spark: extraction, interval algebra, incremental index."""

__version__ = "0.1.0"
