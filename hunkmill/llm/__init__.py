"""Operators for preparing training data from code-review history. Nothing else in the library imports this subpackage."""
