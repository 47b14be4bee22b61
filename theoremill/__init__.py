"""theoremill: a PySpark-native engine for libraries of formalised mathematics."""

__version__ = "0.1.0"
