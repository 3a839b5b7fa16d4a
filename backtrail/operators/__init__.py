"""Operators: ``DataFrame -> DataFrame`` functions that take column names as arguments."""
