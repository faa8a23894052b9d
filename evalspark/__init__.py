"""Table work around model evaluation, written as Spark DataFrame operators."""

__version__ = "0.1.0"
