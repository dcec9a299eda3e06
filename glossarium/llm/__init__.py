"""Operators for large collections of training text; nothing else in the library imports this subpackage."""
