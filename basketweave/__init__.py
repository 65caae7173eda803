"""Session-based recommendation over large event logs, as lazy Spark DataFrame operators."""

__version__ = "0.1.0"
