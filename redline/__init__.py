"""redline: edit-tag text correction as Spark DataFrame operators."""

__version__ = "0.1.0"
