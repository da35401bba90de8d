"""A PySpark-native engine for building, auditing, splitting, scoring and comparing labelled tables."""

__version__ = "0.1.0"
