"""wardstream: event logs into controlled alerts, and the data work around them, on PySpark."""

__version__ = "0.1.0"
