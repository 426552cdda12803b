"""Operators that turn a corpus of documents into training data.

Nothing else in the library imports this subpackage.
"""
