"""corpuslens: a PySpark-native analytics engine for article and document collections."""

__version__ = "0.1.0"
