"""Operators of a training-data pipeline over tables of texts, pages and vectors.

Nothing else in the library imports this package; ``queries`` registers its operators.
"""
