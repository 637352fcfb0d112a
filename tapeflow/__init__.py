"""tapeflow: a Spark-native engine for order-by-order market event tables."""

__version__ = "0.1.0"
