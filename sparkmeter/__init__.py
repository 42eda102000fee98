"""sparkmeter: a PySpark-native analytics engine for the session logs of AI coding agents."""

__version__ = "0.1.0"
