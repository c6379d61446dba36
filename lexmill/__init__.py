"""lexmill: a PySpark-native engine for passage search, provenance graphs and corpus preparation."""

__version__ = "0.1.0"
