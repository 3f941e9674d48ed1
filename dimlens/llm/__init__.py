"""Operators for preparing training data: documents, embeddings and their labels.

Nothing else in the library imports this subpackage. ``queries`` registers one query per operator.
"""
