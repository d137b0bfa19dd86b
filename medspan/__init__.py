"""medspan: a PySpark-native engine that links medication mentions in text to a drug terminology."""

__version__ = "0.1.0"
