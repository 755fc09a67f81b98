"""dsforge: a Spark-native engine that turns pages, documents and JSON records into typed tables."""

__version__ = "0.1.0"
