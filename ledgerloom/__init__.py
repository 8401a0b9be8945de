"""ledgerloom: a PySpark-native engine for report question answering data."""

__version__ = "0.1.0"
