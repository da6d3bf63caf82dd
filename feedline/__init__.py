"""feedline: price-feed and listing analytics on PySpark."""

__version__ = "0.1.0"
