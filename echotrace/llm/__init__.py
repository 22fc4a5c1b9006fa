"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage. `queries.py` holds the thin
queries over the operators, and their SQL where SQL can express them.
"""
