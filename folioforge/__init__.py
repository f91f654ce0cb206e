"""folioforge: a Spark-first analytics engine for documentation collections."""

__version__ = "0.1.0"
