"""Operators for large training-data pipelines over text, vectors and web captures.

Nothing else in the library imports this subpackage.
"""
