"""Operators for training-data pipelines over documents and web pages.

Nothing else in the package imports this subpackage; it can be removed whole.
"""
