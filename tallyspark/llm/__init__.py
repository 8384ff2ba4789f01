"""Operators for building language-model training data at cluster scale.

Nothing outside this subpackage imports it; see ``queries.py`` for the registered queries.
"""
