"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage.  Every module holds one
operator; ``queries`` binds them to the driver's tables.
"""
