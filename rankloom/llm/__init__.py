"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; queries and their SQL are in ``queries``.
"""
